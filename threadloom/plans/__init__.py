"""Queries over the driver's tables, each with its oracle in SQL."""
