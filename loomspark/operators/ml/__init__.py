"""Learners as distributed sufficient statistics, iterative joins, or groups of sequential work."""
