"""Candidate screening and ranking as Spark DataFrame jobs.

Every relation is keyed by ``(role, candidate_id)``. Operators are functions from
DataFrames to DataFrames; the clock is an argument, so a rerun gives the same rows.
"""
