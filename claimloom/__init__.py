"""Claim checking over knowledge graphs, as Spark DataFrame operators."""
