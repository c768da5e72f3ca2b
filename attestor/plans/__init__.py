"""Whole-job plans, the registered queries and their SQL checks."""
