"""Registered queries over the input tables."""

from __future__ import annotations

import importlib

MODULES = (
    "text_queries",
    "corpus_queries",
    "retrieval_queries",
    "catalog_queries",
    "telemetry_queries",
    "index_queries",
    "stream_queries",
)


def load_all():
    """Import every query module once and return the registry."""
    for name in MODULES:
        importlib.import_module(f"corpusloom.plans.{name}")
    return importlib.import_module("corpusloom.plans.registry")
