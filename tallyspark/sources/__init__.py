"""Readers of raw payloads and tables."""
