"""Queries of the operators group."""
