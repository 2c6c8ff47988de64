"""Structured Streaming versions of batch operators; each is checked against its batch twin."""
