"""Scalar functions: k-mer coding, set metrics, names."""
