"""Composite pipelines, fixtures and the registered queries."""
