"""plans of the scanning engine."""
