"""Operators over fields, events, pairs and networks."""
