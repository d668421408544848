"""Incremental feed processing."""
