"""Named queries over the given tables, each with its oracle text where SQL can state it."""

from __future__ import annotations

import importlib

GROUPS = ("panels", "stats", "series", "market", "quality", "econometrics", "forecast", "graph", "regimes", "sources")


def load_all():
    """Imports every group once and returns the registered queries by name."""
    for group in GROUPS:
        importlib.import_module(f"panelwright.catalog.{group}_queries")
    from panelwright.catalog.registry import QUERIES

    return dict(sorted(QUERIES.items()))
