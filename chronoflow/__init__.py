"""Temporal flow-graph analytics as declarative Spark plans."""
