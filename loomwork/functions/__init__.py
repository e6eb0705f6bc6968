"""Column functions, metrics, curves and image kernels."""
