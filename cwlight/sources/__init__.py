"""Sources of the recording engine."""
