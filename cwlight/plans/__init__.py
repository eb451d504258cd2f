"""Plans of the recording engine."""
