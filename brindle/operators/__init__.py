"""operators of the scanning engine."""
