"""Streaming of the mobility engine."""
