"""Operators put together into whole plans, and the registered queries."""
