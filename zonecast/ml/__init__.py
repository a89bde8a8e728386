"""Spark ML members, cross-validation protocol and ensemble scoring."""
