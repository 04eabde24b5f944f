"""Structured Streaming extensions (the batch operators have no streaming counterpart to match)."""
