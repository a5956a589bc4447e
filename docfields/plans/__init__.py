"""Whole plans: extraction, results and the service."""
