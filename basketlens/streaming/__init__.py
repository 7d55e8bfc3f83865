"""Structured Streaming entry points (the stateless anonymiser)."""
