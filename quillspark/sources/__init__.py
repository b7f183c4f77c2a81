"""Readers and writers at the engine's edges."""
