"""Streaming forms of sequential logs and windows."""
