"""Readers that attach a row order, and writers."""
