"""Incremental note processing."""
