"""Relational operators over the procurement data model."""
