"""Evaluation and observability analytics for model variants, on PySpark."""

__version__ = "0.1.0"
