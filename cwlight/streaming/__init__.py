"""Streaming of the recording engine."""
