"""Queries of the plans group."""
