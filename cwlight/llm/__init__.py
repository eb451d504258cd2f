"""Operators for preparing training text at scale.

Nothing outside this folder imports it.  ``queries`` holds the registered
queries; every other module is one operator with its own general interface.
"""
