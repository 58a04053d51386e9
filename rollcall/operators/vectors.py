"""Statistics of item vectors per entity, for every dimension.

Vectors travel whole: the rows of an entity meet once, as arrays, and all entities of an
Arrow batch are worked on together.  Entities with more rows than a task should hold are
exploded instead, and their quantiles come from the sliced path of ``grouped``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.operators.grouped import group_quantiles, same_keys
from rollcall.session import settle_counted

#: rows of one entity that a task holds
ENTITY_ROWS = 50_000
#: rows of whole entities that are worked on together
BLOCK_ROWS = 10_000
PROBABILITIES = {"median": 0.5, "p10": 0.1, "p90": 0.9}
STATISTICS = ("mean", "std", *PROBABILITIES, "n")


def block_statistics(x: np.ndarray, w: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics per group and dimension of rows that lie group by group; NaN is missing.

    ``first`` has the first row of every group.  The mean is weighted over the values
    that are there, sd (population) and quantiles (linear) are not; a dimension without
    values is NaN with n 0.
    """
    sizes = np.diff(np.append(first, len(x)))
    group = np.repeat(np.arange(first.size), sizes)
    there = ~np.isnan(x)
    zero = np.where(there, x, 0.0)
    total = lambda v: np.add.reduceat(v, first, axis=0)
    n = total(there.astype(float))
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = total(zero * w[:, None]) / total(there * w[:, None])
        plain = total(zero) / n
        std = np.sqrt(total(np.where(there, x - plain[group], 0.0) ** 2) / n)
    out = {"mean": mean, "std": std, "n": n}
    ordered = np.empty_like(x)
    for d in range(x.shape[1]):  # missing values come last in their group
        ordered[:, d] = x[np.lexsort((x[:, d], group)), d]
    columns = np.arange(x.shape[1])
    for name, p in PROBABILITIES.items():
        place = np.maximum(n - 1, 0) * p
        low = np.floor(place)
        below = ordered[first[:, None] + low.astype(int), columns]
        above = ordered[first[:, None] + np.ceil(place).astype(int), columns]
        out[name] = np.where(n > 0, below + (above - below) * (place - low), np.nan)
    return out


def _streamed(rows: DataFrame, entity: str) -> DataFrame:
    """Statistics of rows that are sorted by entity in their partitions."""
    kind = dict(rows.dtypes)[entity]

    def worked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        count = 0

        def done(block: pd.DataFrame) -> pd.DataFrame:
            keys = block[entity]
            codes = pd.factorize(keys, use_na_sentinel=False)[0]
            first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            x = np.array([np.asarray(v, dtype=float) for v in block["_x"]])
            found = block_statistics(x, block["_w"].to_numpy(float), first)
            out = pd.DataFrame({entity: keys.iloc[first].to_numpy()})
            for name in STATISTICS:
                out[name] = list(found[name])
            return out

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            count += len(batch)
            if count >= BLOCK_ROWS:
                block = pd.concat(held, ignore_index=True)
                codes = pd.factorize(block[entity], use_na_sentinel=False)[0]
                last = int(np.flatnonzero(codes == codes[-1])[0])  # the last entity may go on
                if last:
                    yield done(block.iloc[:last].reset_index(drop=True))
                held = [block.iloc[last:].reset_index(drop=True)]
                count = len(held[0])
        if held:
            yield done(pd.concat(held, ignore_index=True))

    arrays = ", ".join(f"{name} array<double>" for name in STATISTICS)
    return rows.mapInPandas(worked, f"`{entity}` {kind}, {arrays}")


def _exploded(rows: DataFrame, entity: str) -> DataFrame:
    """The same for entities of any size: value by value, and put together again."""
    long = rows.select(entity, "_w", F.posexplode("_x").alias("dim", "value"))
    long = long.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    aggs = {"mean": F.sum(F.col("_w") * F.col("value")) / F.sum("_w"), "std": F.stddev_pop("value"), "n": F.count(F.lit(1)).cast("double")}
    found = group_quantiles(long, [entity, "dim"], "value", PROBABILITIES, aggs=aggs)
    width = rows.agg(F.max(F.size("_x")).alias("n")).select("n").scalar()
    packed = found.groupBy(entity).agg(F.map_from_entries(F.collect_list(F.struct("dim", F.struct(*STATISTICS).alias("s")))).alias("_s"))
    packed = packed.withColumn("_dims", F.sequence(F.lit(0), width - 1))

    def array(name: str) -> Column:
        none = F.lit(0.0) if name == "n" else F.lit(None).cast("double")
        return F.transform("_dims", lambda d: F.coalesce(F.try_element_at("_s", d)[name], none)).alias(name)

    return packed.select(entity, *[array(c) for c in STATISTICS])


def vector_statistics(df: DataFrame, entity: str, vector: str, weight: str) -> DataFrame:
    """Per entity one array per statistic over the dimensions: mean, std, median, p10, p90, n.

    Vectors have one width, with NULL or NaN where a value is missing; rows without a
    vector are left out.  A missing statistic is NaN or NULL.  NULL is an entity of its own.
    """
    rows = df.where(F.col(vector).isNotNull()).select(entity, F.col(weight).cast("double").alias("_w"), F.col(vector).cast("array<double>").alias("_x"))
    hot, n_hot = settle_counted(rows.groupBy(entity).count().where(F.col("count") > ENTITY_ROWS).select(entity))
    sorted_ = lambda r: r.repartition(F.col(entity)).sortWithinPartitions(entity)
    if not n_hot:
        return _streamed(sorted_(rows), entity)
    # at most rows / ENTITY_ROWS entities are hot
    marked = same_keys(rows, hot.withColumn("_hot", F.lit(True)), [entity], "left")
    cold = marked.where(F.col("_hot").isNull()).drop("_hot")
    return _streamed(sorted_(cold), entity).unionByName(_exploded(marked.where("_hot").drop("_hot"), entity))


def vector_statistics_long(df: DataFrame, entity: str, vector: str, weight: str) -> DataFrame:
    """The same, one row per entity and dimension; NaN becomes NULL."""
    zipped = F.posexplode(F.arrays_zip(*STATISTICS)).alias("dim", "s")
    number = lambda c: F.when(~F.isnan(f"s.{c}"), F.col(f"s.{c}")).alias(c)
    return vector_statistics(df, entity, vector, weight).select(entity, zipped).select(
        entity, "dim", *[number(c) for c in STATISTICS if c != "n"], F.col("s.n").cast("long").alias("n")
    )


def entity_vectors(df: DataFrame, entity: str, vector: str, weight: str, statistics: Sequence[str] = ("mean", "median", "std", "p10", "p90")) -> DataFrame:
    """One feature vector per entity: the statistics one after the other, then item count and mean, sd, min and max of the weights."""
    weights = df.where(F.col(vector).isNotNull()).groupBy(entity).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(weight).alias("m"), F.stddev_pop(weight).alias("s"), F.min(weight).alias("lo"), F.max(weight).alias("hi")
    )
    more = weights.select(entity, F.array(*[F.col(c).cast("double") for c in ("n", "m", "s", "lo", "hi")]).alias("_more"))
    found = vector_statistics(df, entity, vector, weight)
    return same_keys(found, more, [entity], "inner").select(entity, F.concat(*statistics, "_more").alias("features"))
