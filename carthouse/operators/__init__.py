"""Relational operators: projections, aggregates, merges, scans, carts."""
