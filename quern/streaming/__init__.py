"""Queries of the streaming group."""
