"""Reviewer overrides as a stream."""
