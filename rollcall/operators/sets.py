"""Set operations on manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    """Stack parsed sources; a column one source lacks is NULL there."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def union_support(
    base: DataFrame, collected: DataFrame, columns: Sequence[str],
    roles: Sequence[str] = ("development", "train_support_only"), labels: Sequence[str] = ("Male", "Female"),
) -> DataFrame:
    """Base rows plus collected rows whose role and label allow training."""
    allowed = collected.filter(
        F.lower(F.trim("collection_role")).isin(*roles) & F.trim("label").isin(*labels)
    )
    return base.select(*columns).unionByName(allowed.select(*columns))


def union_development(train: DataFrame, val: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Train and validation rows on the columns both have."""
    common = [c for c in train.columns if c in val.columns]
    absent = [c for c in keep if c not in common]
    if absent:
        raise ValueError(f"columns missing in one split: {absent}")
    return train.select(*common).unionByName(val.select(*common))


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def missing_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of ``a`` that ``b`` does not have."""
    return a.select(key).subtract(b.select(key))


def unique_counts(df: DataFrame, key: str, by: str, approximate: bool = False) -> DataFrame:
    """Distinct keys per group and overall (group NULL)."""
    count = F.approx_count_distinct(key) if approximate else F.count_distinct(key)
    return df.rollup(by).agg(count.alias("n_unique"), F.count(F.lit(1)).alias("n_rows"))
