"""Queries of the functions group."""
