"""Lineage events and observations that arrive over time, with Structured Streaming."""
