"""Vessel-monitoring analytics expressed as Spark DataFrame transformations."""
