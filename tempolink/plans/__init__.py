"""Whole analyses, from fields to networks."""
