"""Surveillance analytics on Spark: lazy DataFrame operators, sources and query plans."""
