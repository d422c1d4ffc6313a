"""Spark analytics over crawled small-business sites and their usage, credit and payment records."""

__version__ = "0.1.0"
