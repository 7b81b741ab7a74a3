"""Structured Streaming forms of stateful operators."""
