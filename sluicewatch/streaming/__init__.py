"""Structured Streaming forms of the alert, trend and status queries."""
