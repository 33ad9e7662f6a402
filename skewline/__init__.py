"""Spark-first analytics for option trades, volatility surfaces and their inference."""

__version__ = "0.1.0"
