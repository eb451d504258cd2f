"""Operators of the recording engine."""
