"""Spark-first analytics for collections of transcript structures."""

__version__ = "0.1.0"
