"""streaming of the scanning engine."""
