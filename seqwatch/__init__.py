"""Sequence curation and case surveillance as Spark DataFrame transformations."""
