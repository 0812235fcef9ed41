"""Whole studies as lazy plans over long frames; kernels run in grouped maps."""
