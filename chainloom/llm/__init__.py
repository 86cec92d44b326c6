"""Operators for preparing documents and scored records as training data."""
