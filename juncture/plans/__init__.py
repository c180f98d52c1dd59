"""Registered plans."""

import importlib

MODULES = ["barcodes", "expressions", "sources", "reads", "isoforms", "statistics", "evaluation", "annotation", "scoring", "pairs", "relational", "contigs"]


def load_all():
    """Import every plan module and return the registry."""
    from juncture.plans.registry import QUERIES

    for name in MODULES:
        importlib.import_module(f"juncture.plans.{name}")
    return QUERIES
