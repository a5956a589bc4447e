"""Readers and text recognition engines."""
