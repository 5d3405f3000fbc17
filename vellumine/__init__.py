"""Vellumine: document analytics expressed as Spark DataFrame operators."""
