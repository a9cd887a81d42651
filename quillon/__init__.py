"""Quillon: corpus-quality analytics for semi-structured, machine-generated text, on Spark."""
