"""Signed-graph analytics on PySpark."""
