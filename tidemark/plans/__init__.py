"""Expressions, the logical plan and the query builder."""
