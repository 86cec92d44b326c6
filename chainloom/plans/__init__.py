"""Helpers that shape physical plans: durable cuts, table access, skew handling."""
