"""Acceptance gates over metric tables, and the run registry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def target_gate(metrics: DataFrame, metric: str, value: str, limits: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Each metric against its fixed limit: ``(max | min, limit)``."""
    rows = F.when(F.lit(False), F.struct(F.lit("").alias("kind"), F.lit(0.0).alias("limit")))
    for name, (kind, limit) in limits.items():
        rows = rows.when(F.col(metric) == name, F.struct(F.lit(kind).alias("kind"), F.lit(float(limit)).alias("limit")))
    joined = metrics.withColumn("_l", rows).filter("_l IS NOT NULL")
    met = F.when(F.col("_l.kind") == "max", F.col(value) <= F.col("_l.limit")).otherwise(F.col(value) >= F.col("_l.limit"))
    return joined.select(*metrics.columns, F.col("_l.limit").alias("limit"), F.coalesce(met, F.lit(False)).alias("met"))


def metric_value(split: str, names: Sequence[str]) -> Column:
    """Smallest known value of several metric variants in one split."""
    return F.min(F.when((F.col("split") == split) & F.col("metric").isin(*names), F.col("value")))


def multi_gate(metrics: DataFrame, run: str, limits: Mapping[str, float]) -> DataFrame:
    """Four PASS/BLOCK checks per run from a long (run, split, metric, value) table.

    The best variant of a metric counts; a missing value blocks.
    """
    both = lambda name: (name, f"{name}_omega")
    wide = metrics.groupBy(run).agg(
        metric_value("val", (*both("mae"), *both("balanced"))).alias("val"),
        metric_value("test", both("mae")).alias("test"),
        metric_value("test", both("balanced")).alias("balanced"),
        metric_value("test", both("short")).alias("short"),
    )
    checks = {
        "sealed_test_speaker_mae": F.col("test"),
        "short_tail_speaker_mae": F.col("short"),
        "balanced_speaker_mae": F.col("balanced"),
        "val_test_gap": F.col("test") - F.col("val"),
    }
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("check"), v.alias("value"), F.lit(float(limits[n])).alias("threshold"),
                F.when(v <= limits[n], "PASS").otherwise("BLOCK").alias("verdict"),
            )
            for n, v in checks.items()
        ]
    )
    return wide.select(run, F.explode(rows).alias("_c")).select(run, "_c.*")


def promotion(
    wide: DataFrame, old_val: str, new_val: str, old_test: str, new_test: str, worst: str, min_gain: float = 0.10, max_worse: float = 0.30
) -> DataFrame:
    """promote / kill, or hold when a number is missing."""
    val_gain, test_gain = F.col(old_val) - F.col(new_val), F.col(old_test) - F.col(new_test)
    known = val_gain.isNotNull() & test_gain.isNotNull()
    fine = (val_gain >= min_gain) & (test_gain >= min_gain) & F.coalesce(F.col(worst) <= max_worse, F.lit(True))
    return wide.withColumns(
        {
            "val_gain": val_gain,
            "test_gain": test_gain,
            "decision": F.when(~known, "hold").when(fine, "promote").otherwise("kill"),
        }
    )


def append_registry(rows: DataFrame, path: str) -> None:
    """Append run records; an existing registry is never rewritten."""
    rows.write.mode("append").parquet(path)


def latest_registry(table: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Last record per (stage, variant, seed)."""
    rest = [c for c in table.columns if c not in keys]
    last = table.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_r"))
    return last.select(*keys, "_r.*")


def stop_status(value: Column, target: float, mode: str = "min") -> Column:
    """Was the target reached?  Unknown values did not reach it."""
    hit = value >= target if mode == "max" else value <= target
    return F.coalesce(hit & ~F.isnan(value), F.lit(False))
