"""NumPy kernels for what relational operators cannot express; each sees one market, window or series at a time."""
