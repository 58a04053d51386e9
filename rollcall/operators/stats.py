"""Bootstrap intervals that shuffle replicate sums, never resampled rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions.hashing import hash_order

#: rows and replicates whose draws are made by one array operation; the arrays stay in a core's cache
BLOCK, SPAN = 64, 500
#: draws are hashes modulo this prime
PRIME = 2**31 - 1
#: chances of a Poisson(1) count of at most 0, 1, 2, ...
POISSON = tuple(float(c) for c in np.cumsum([math.exp(-1.0) / math.factorial(i) for i in range(12)]))
#: smallest hashes whose share of the prime reaches these chances
STEPS = tuple(next(h for h in range(int(c * PRIME) - 2, PRIME + 2) if h / PRIME >= c) for c in POISSON)


def _fold(x: np.ndarray, spare: np.ndarray) -> None:
    """In place: a smaller number with the same remainder modulo the prime, which is 2**31 - 1."""
    np.right_shift(x, 31, out=spare)
    np.bitwise_and(x, PRIME, out=x)
    np.add(x, spare, out=x)


def draws(keys: np.ndarray, repetitions: int, begin: int = 0) -> np.ndarray:
    """(rows, replicates from ``begin``) Poisson(1) counts by inverting a hash of (key, replicate).

    The hash is a cubic in whole numbers below 2**63, so any engine can repeat it.
    """
    k, r = keys.astype(np.int64)[:, None], np.arange(begin, repetitions, dtype=np.int64)[None, :]
    a = k * (2 * r + 1)
    a += 12345
    b, spare = np.empty_like(a), np.empty_like(a)
    _fold(a, spare)
    np.multiply(a, a, out=b)
    b += r
    _fold(b, spare)
    _fold(b, spare)
    b *= a
    b += k
    _fold(b, spare)
    _fold(b, spare)
    # at most the prime + 1 is left
    hashes = b.astype(np.uint32)
    np.subtract(hashes, np.uint32(PRIME), out=hashes, where=hashes >= PRIME)
    counts = np.zeros(hashes.shape, dtype=np.int8)
    for step in STEPS:
        counts += hashes >= np.uint32(step)
    return counts


def draws_sql(key: str, rep: str) -> str:
    """The count of ``draws`` in DuckDB."""
    a = f"(({key} * (2 * {rep} + 1) + 12345) % {PRIME})"
    c = f"(((({a} * {a} + {rep}) % {PRIME}) * {a} + {key}) % {PRIME})"
    return " + ".join(f"({c} / {PRIME}::DOUBLE >= {p!r}::DOUBLE)::INT" for p in POISSON)


def replicate_sums(df: DataFrame, key: str, value: str, seed: int, repetitions: int) -> DataFrame:
    """(rep, total, weight): how often each row counts is Poisson(1) per replicate.

    The draws depend on the row's key alone, not on partitioning, and the method
    is the same for every number of rows.  A task keeps two numbers per replicate.
    Rows are dealt evenly first, as they are few bytes but ``repetitions`` draws each.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, weight = np.zeros(repetitions), np.zeros(repetitions)
        for batch in batches:
            keys, values = batch["_k"].to_numpy(), batch[value].to_numpy(float)
            for start in range(0, len(keys), BLOCK):
                k, v = keys[start : start + BLOCK], values[start : start + BLOCK]
                for at in range(0, repetitions, SPAN):
                    counts = draws(k, min(at + SPAN, repetitions), at)
                    total[at : at + SPAN] += np.einsum("i,ij->j", v, counts)
                    weight[at : at + SPAN] += counts.sum(axis=0, dtype=np.int32)
        yield pd.DataFrame({"rep": np.arange(repetitions), "total": total, "weight": weight})

    number = F.conv(F.substring(hash_order(seed, F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % PRIME
    conf, context = df.sparkSession.conf, df.sparkSession.sparkContext
    tasks = max(int(conf.get("spark.sql.shuffle.partitions")), 2 * context.defaultParallelism)
    sums = df.select(number.alias("_k"), value).repartition(tasks).mapInPandas(partial, "rep int, total double, weight double")
    return sums.groupBy("rep").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))


def bootstrap_means(df: DataFrame, key: str, value: str, seed: int, repetitions: int = 10_000) -> DataFrame:
    rows = df.select(key, value).filter(F.col(value).isNotNull())
    sums = replicate_sums(rows, key, value, seed, repetitions)
    return sums.filter("weight > 0").select("rep", (F.col("total") / F.col("weight")).alias("mean"))


def bootstrap_ci(df: DataFrame, key: str, y: str, pred: str, seed: int, repetitions: int = 10_000) -> DataFrame:
    """95 % interval of the mean absolute error."""
    errors = df.select(key, F.abs(F.col(y) - F.col(pred)).alias("_e"))
    means = bootstrap_means(errors, key, "_e", seed, repetitions)
    point = errors.agg(F.avg("_e").alias("m")).select("m").scalar()
    return means.agg(
        F.percentile("mean", F.lit(0.025)).alias("lower_95"), F.percentile("mean", F.lit(0.975)).alias("upper_95"),
        F.count(F.lit(1)).alias("repetitions"),
    ).withColumn("mae", point)


def paired_bootstrap(df: DataFrame, key: str, y: str, baseline: str, selected: str, seed: int, repetitions: int = 10_000) -> DataFrame:
    """Interval of the paired error difference and the chance of an improvement."""
    gap = F.abs(F.col(y) - F.col(selected)) - F.abs(F.col(y) - F.col(baseline))
    rows = df.select(key, gap.alias("_d"))
    means = bootstrap_means(rows, key, "_d", seed, repetitions)
    point = rows.agg(F.avg("_d").alias("m")).select("m").scalar()
    return means.agg(
        F.percentile("mean", F.lit(0.025)).alias("lower_95"), F.percentile("mean", F.lit(0.975)).alias("upper_95"),
        F.avg((F.col("mean") < 0).cast("double")).alias("probability_improvement"), F.count(F.lit(1)).alias("repetitions"),
    ).withColumn("mean_delta", point)
