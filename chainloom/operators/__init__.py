"""Transcript-structure operators built from DataFrame expressions."""
