"""Operators on plans: reductions, grouping, statistics."""
