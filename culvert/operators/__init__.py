"""Operators over networks."""
