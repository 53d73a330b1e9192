"""Streams: change detection against a stored state, and sessions."""
