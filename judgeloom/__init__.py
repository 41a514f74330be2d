"""Preference-evaluation analytics on Spark."""
