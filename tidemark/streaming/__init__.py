"""Incremental views: Z-sets, live queries and change logs."""
