"""Readers and the adapter views over the input tables."""
