"""Structured Streaming versions of arrival and approval."""
