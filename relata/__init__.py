"""Relation analytics on Spark: audits, ranking, pairing, selection, metrics and comparison as DataFrame transformations."""
