"""Operators over streams of status events."""
