"""Streaming counterparts of batch operators."""
