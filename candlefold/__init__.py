"""Spark analytics over market bars, and corpus operators in ``llm``."""
