"""functions of the scanning engine."""
