"""Operators over pull-request frames: each takes and returns a DataFrame."""
