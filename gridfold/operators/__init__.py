"""Operators from DataFrame to DataFrame: filters, spatial joins, lookups, register matching, density."""
