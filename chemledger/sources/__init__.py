"""Readers of registry tables and of the files around them, and the evidence writer."""
