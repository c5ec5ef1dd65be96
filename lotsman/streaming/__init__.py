"""Arrivals in pages: quotas filled batch by batch, with a state that is a table."""
