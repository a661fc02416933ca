"""Readers, writers and clients at the edge of the engine."""
