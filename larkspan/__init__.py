"""Larkspan: vector, text and hybrid search analytics expressed as Spark DataFrame programs."""
