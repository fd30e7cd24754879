"""Stateless stages run over Structured Streaming (an extension)."""
