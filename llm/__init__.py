"""Operators of a training-data pipeline, each with a registered query over the given tables."""

from __future__ import annotations

import sys
from collections.abc import Callable
from importlib import import_module

from pyspark import cloudpickle

# Functions of this package travel to executors whole, so the workers need no copy on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODULES = (
    "personal_data", "quality", "sharding", "html_text", "contamination", "packing", "language", "near_copies", "vectors", "substrings", "byte_pairs", "phrases", "runs",
)


def queries() -> dict[str, Callable]:
    """Query name to `(spark, folder) -> DataFrame`, the whole pipeline included."""
    import corpus_pipeline

    out: dict[str, Callable] = {}
    for name in MODULES:
        out.update(import_module(f"{__name__}.{name}").QUERIES)
    out["pipeline"] = corpus_pipeline.run
    return out


def oracle_sql() -> dict[str, str]:
    """Query name to SQL text, for the operators SQL can state."""
    out: dict[str, str] = {}
    for name in MODULES:
        out.update(getattr(import_module(f"{__name__}.{name}"), "ORACLE", {}))
    return out
