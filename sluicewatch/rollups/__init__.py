"""Stored aggregates that batches and streams add to, and reports that read only these."""
