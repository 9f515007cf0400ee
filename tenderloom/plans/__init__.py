"""Queries over the test tables, with the SQL they must equal."""
