"""Relational building blocks of path expansion."""
