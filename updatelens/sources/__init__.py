"""Readers of raw feeds, pages and messages, and idempotent writers."""
