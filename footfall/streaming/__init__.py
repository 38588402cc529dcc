"""Continuous versions of the batch jobs, on the same column functions."""
