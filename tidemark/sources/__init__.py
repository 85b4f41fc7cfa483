"""Readers, record shapes and adapters; every function returns a DataFrame."""
