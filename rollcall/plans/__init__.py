"""Registered queries over the given tables."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from rollcall.plans.registry import QUERIES, SQL, Query

MODULES = ("scalars", "frames", "rules", "audit", "profile", "pooling", "metrics", "ensemble", "sampling", "learn", "sources", "streaming")


def _import_all() -> None:
    for name in MODULES:
        importlib.import_module(f"rollcall.plans.{name}")


def all_queries() -> dict[str, Query]:
    _import_all()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _import_all()
    return dict(SQL)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Train-only shrunken group prior, scored and sliced on the test split."""
    return all_queries()["entry_prior_slices"](spark, sf)
