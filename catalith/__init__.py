"""Catalog analytics on Spark: observations, golden records, quality, graph and search as DataFrame operators."""
