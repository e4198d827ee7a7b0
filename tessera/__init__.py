"""Governed data contracts on Spark."""
