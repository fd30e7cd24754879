"""Readers for dumps, tables and packed binaries, and the matching writers."""
