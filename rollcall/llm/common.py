"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.session import settle, settle_counted

#: separators of words: ASCII white space, so that a word is a match of ``[^\x20\x09-\x0D]+``
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def null_safe_key(column: Column) -> Column:
    """A string key that keeps NULL apart from every value."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("~"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on an array of unsigned 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if _powers.get("n", np.zeros(0)).size < n:
        size = max(n, 1 << 16)
        up = np.full(size, _P, dtype=_U)
        down = np.full(size, _P_INV, dtype=_U)
        up[0] = down[0] = 1
        _powers["n"], _powers["inv"] = np.cumprod(up), np.cumprod(down)
    return _powers["n"], _powers["inv"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash: entry i covers the bytes before i."""
    out = np.zeros(data.size + 1, dtype=_U)
    powers, _ = _power_table(data.size + 1)
    np.cumsum((data.astype(_U) + _U(1)) * powers[: data.size], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for arrays of bounds, from ``prefix_hash``."""
    _, inverse = _power_table(prefix.size)
    return mix64((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(_U))


def utf8_blocks(column: pa.Array, limit: int = 2_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a string column into blocks of about ``limit`` bytes.

    Yields (first row, bounds of the rows in the block, bytes); NULL is empty.  A
    text is never cut: a block holds one row at least.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, side="right")) - 1)
        last = min(last, n)
        yield row, bounds[row : last + 1] - bounds[row], raw[bounds[row] : bounds[last]]
        row = last


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of every row of a block: starts, ends and the first word of each row (n + 1 entries)."""
    inside = ~IS_SPACE[data]
    opened = inside.copy()
    opened[1:] &= ~inside[:-1]
    firsts = bounds[:-1][bounds[:-1] < data.size]
    opened[firsts] |= inside[firsts]
    closed = inside.copy()
    closed[:-1] &= ~inside[1:]
    lasts = bounds[1:][bounds[1:] > 0] - 1
    closed[lasts] |= inside[lasts]
    starts, ends = np.flatnonzero(opened), np.flatnonzero(closed) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of a block, and the first word of each row."""
    starts, ends, first = word_bounds(data, bounds)
    return range_hash(prefix_hash(data), starts, ends), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of each row, and the first shingle of each row.

    A row with fewer words, but one at least, has one shingle: all its words.
    """
    count = np.diff(first)
    made = np.where(count >= width, count - width + 1, (count > 0).astype(count.dtype))
    out_first = np.concatenate([[0], np.cumsum(made)])
    if not out_first[-1]:
        return np.zeros(0, dtype=_U), out_first
    padded = np.concatenate([words, np.zeros(width, dtype=_U)])
    at = np.repeat(first[:-1] - out_first[:-1], made) + np.arange(out_first[-1])
    left = np.repeat(first[1:], made) - at
    full = np.zeros(at.size, dtype=_U)
    for i in range(width):
        full = full * _U(0xD6E8FEB86659FD93) + np.where(left > i, padded[at + i], _U(0x632BE5AB))
    return mix64(full), out_first


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: (node, root), root being the smallest node of the component.

    Every node takes the smallest label next to it, then the label of its label, until
    nothing changes.  Labels lie in a written table after each round; no group of
    neighbours is ever gathered, a hub is only a key with many rows of a minimum.
    Nodes are strings; nodes without edges do not appear.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    both = settle(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels, _ = settle_counted(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("root")))
    while True:
        near = (
            both.join(labels, F.col("v") == F.col("node"))
            .groupBy("u").agg(F.min("root").alias("low"))
        )
        lower = labels.join(near, F.col("node") == F.col("u"), "left").select(
            "node", F.col("root").alias("old"), F.least("root", F.coalesce("low", "root")).alias("next")
        )
        jump = labels.select(F.col("node").alias("via"), F.col("root").alias("beyond"))
        moved = lower.join(jump, F.col("next") == F.col("via"), "left").select(
            "node", F.least("next", F.coalesce("beyond", "next")).alias("root"), "old"
        )
        moved = settle(moved)
        changed = moved.where("root <> old").limit(1).count()
        labels = moved.select("node", "root")
        if not changed:
            return labels
