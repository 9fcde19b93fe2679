"""Tidemark: coverage-complete archives of one-minute market bars, on Spark."""

__version__ = "0.1.0"
