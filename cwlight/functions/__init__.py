"""Functions of the recording engine."""
