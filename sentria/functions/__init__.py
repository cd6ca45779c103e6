"""Column functions and the NumPy kernels used inside vectorised UDFs."""
