"""Registered queries with the SQL that states the same result."""
