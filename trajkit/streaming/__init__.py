"""Structured Streaming counterparts of the append log and of resumable collection."""
