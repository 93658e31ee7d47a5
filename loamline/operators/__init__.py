"""Relational operators: ledgers, samples, splits, graphs, aggregates, inference."""
