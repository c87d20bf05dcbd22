"""Operators: DataFrame -> DataFrame functions (builds, metrics, lookups, model)."""
