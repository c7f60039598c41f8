"""Column-level functions: special functions, distributions, windows, vectors, rotations."""
