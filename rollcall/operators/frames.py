"""Operators on frame sequences: statistics, repair, projection."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions import arrays as A
from rollcall.operators.grouped import lookup_join


def sorted_quantile(values: Column, p: float) -> Column:
    """Linear quantile of an ascending array without NULLs."""
    place = (F.size(values) - 1) * F.lit(p)
    low = F.get(values, F.floor(place).cast("int"))
    high = F.get(values, F.ceil(place).cast("int"))
    return low + (high - low) * (place - F.floor(place))


def frame_stats(df: DataFrame, key: str, frames: str, width: int) -> DataFrame:
    """Ten statistics per item and dimension, NULL-aware, without any shuffle."""
    frame = F.col(frames)
    dims = F.array(
        *[F.array_sort(F.filter(A.column_of(frame, d), lambda x: x.isNotNull())) for d in range(width)]
    )
    rows = df.select(
        key,
        F.size(frame).cast("long").alias("n_frames"),
        F.posexplode(dims).alias("dim", "_v"),
    )
    v = F.col("_v")
    mean = A.array_mean(v)
    rows = rows.withColumn("mean", mean)
    spread = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean")))
    return rows.select(
        key,
        "dim",
        "n_frames",
        F.when(F.col("n_frames") > 0, F.size(v) / F.col("n_frames")).alias("finite_ratio"),
        "mean",
        F.sqrt(spread / F.nullif(F.size(v), F.lit(0))).alias("std"),
        *[
            sorted_quantile(v, p).alias(n)
            for n, p in (("median", 0.5), ("p10", 0.1), ("p25", 0.25), ("p75", 0.75), ("p90", 0.9))
        ],
        (sorted_quantile(v, 0.75) - sorted_quantile(v, 0.25)).alias("iqr"),
        F.get(v, F.lit(0)).alias("min"),
        F.get(v, F.size(v) - 1).alias("max"),
    )


def repair_frames(
    df: DataFrame, frames: str, source: int, target: int, tag: str, speed: float = 34000.0
) -> DataFrame:
    """Rewrite frame entry ``target`` from ``source`` and refresh the item scalars."""
    lo, hi = A.spacing_bounds(speed, 10.0, 35.0)
    before, spacing = A.column_of(F.col(frames), target), A.column_of(F.col(frames), source)
    positive = lambda c: F.filter(c, lambda x: x > 0)
    out = df.withColumns({"_old": before, "_gap": spacing}).withColumn(
        frames, A.repair_column(F.col(frames), source, target, lambda x: A.robust_inverse(x, speed))
    )
    new = A.column_of(F.col(frames), target)
    return out.withColumns(
        {
            "old_mean": A.array_mean(positive(F.col("_old"))),
            "old_max": F.array_max(positive(F.col("_old"))),
            "new_mean": A.array_mean(positive(new)),
            "new_max": F.array_max(positive(new)),
            "value_median": F.coalesce(A.array_median(positive(new)), F.lit(0.0)),
            "invalid_source_rate": A.share(F.col("_gap"), lambda x: (x <= 0) | (x < lo) | (x > hi)),
            "invalid_target_rate": A.share(new, lambda x: x <= 0),
            "repair_tag": F.lit(tag),
        }
    ).drop("_old", "_gap")


def projection_matrix(width: int, out_width: int, seed: int) -> np.ndarray:
    """Seeded Gaussian projection, scaled by the output width.

    Entries are normal numbers made from the md5 of (seed, row, column), so any
    engine can rebuild the matrix.
    """
    def uniform(name: str, i: int, j: int) -> float:
        return int(hashlib.md5(f"{seed}{name}:{i}:{j}".encode()).hexdigest()[:13], 16) / 2.0**52

    cells = [
        [
            np.sqrt(-2.0 * np.log(max(uniform("a", i, j), 2.0**-53))) * np.cos(2.0 * np.pi * uniform("b", i, j))
            for j in range(out_width)
        ]
        for i in range(width)
    ]
    return np.array(cells) / np.sqrt(out_width)


def random_projection(df: DataFrame, key: str, vector: str, width: int, out_width: int, seed: int) -> DataFrame:
    """Project every vector and scale it to unit length; one matrix product per Arrow batch."""
    key_type = dict(df.dtypes)[key]

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix = projection_matrix(width, out_width, seed)
        for batch in batches:
            if batch.empty:
                continue
            out = np.stack(batch[vector].to_numpy()).astype(float) @ matrix
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            out = out / np.where(norm > 0, norm, 1.0)
            yield pd.DataFrame({key: batch[key], "projected": list(out)})

    return df.select(key, vector).mapInPandas(project, f"{key} {key_type}, projected array<double>")


def once_per_input(df: DataFrame, inputs: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Compute per distinct input, then hand the value to every row that refers to it."""
    return lookup_join(df, compute(df.select(*inputs).distinct()), inputs)
