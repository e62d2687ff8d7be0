"""Structured Streaming form of ingestion and running profiles."""
