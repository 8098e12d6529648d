"""Builds that derive many tables from one kind of input."""
