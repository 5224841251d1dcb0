"""Operators of the mobility engine."""
