"""Randomness and fingerprints from hashes, so that reruns agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_order(seed: object, *cols: Column | str) -> Column:
    """Hex string to sort by: a seeded shuffle."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c) if isinstance(c, str) else c for c in cols]))


def hash_uniform(seed: object, *cols: Column | str) -> Column:
    """Uniform in [0, 1) from the first 52 bits of the seeded md5."""
    return F.conv(F.substring(hash_order(seed, *cols), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def row_fingerprint(columns: Sequence[str]) -> Column:
    """sha256 of the row as JSON with the columns in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def table_fingerprint(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Order-free fingerprint of a table: row count and three hash sums, as decimal text."""
    digest = df.select(*keys, row_fingerprint(columns).alias("_h"))
    parts = [
        F.sum(F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"hash_sum_{i}") for i in range(3)
    ]
    return digest.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *parts)
