"""Scholarly graph analytics and large-corpus preparation on Spark."""
