"""Relational operators over labelled vectors."""
