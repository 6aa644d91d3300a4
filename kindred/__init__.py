"""Exact nearest-neighbour label retrieval, expressed as Spark DataFrame operators."""
