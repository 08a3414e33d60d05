"""Budgeted selection analytics on Spark."""
