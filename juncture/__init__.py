"""Barcoded splicing-assay analytics expressed as Spark DataFrame transformations."""
