"""Queries over the given tables, each with an equivalent SQL statement where one exists."""
