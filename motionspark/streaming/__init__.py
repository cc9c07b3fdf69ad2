"""Queries over samples that still arrive."""
