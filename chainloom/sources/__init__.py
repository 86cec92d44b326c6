"""Readers and writers for annotation, read and manifest files."""
