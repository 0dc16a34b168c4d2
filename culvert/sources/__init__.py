"""Readers of network, rainfall and drawing files."""
