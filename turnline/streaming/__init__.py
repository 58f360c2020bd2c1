"""Streaming plans over flights."""
