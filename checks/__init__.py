"""Queries over the provided tables, each with the SQL that must give the same rows."""
