"""sources of the scanning engine."""
