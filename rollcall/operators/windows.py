"""Ordered operators: keep-first, running best, moving error, top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.operators.grouped import attach, measured, positions, running


def keep_first(df: DataFrame, entity: str, digest: str, order: Sequence[str], item_reason: str = "reason", label: str = "duplicate_within_entity") -> DataFrame:
    """Later repeats of an accepted content within an entity are rejected.

    Only the first place per (entity, content) is needed, a minimum; a content
    with very many repeats is neither sorted nor gathered in one task.
    """
    ok = F.col(item_reason).isNull()
    joined = attach(df, [entity, digest], {"_first": F.min(F.when(ok, F.struct(*order)))})
    repeat = ok & (F.struct(*order) > F.col("_first"))
    return joined.withColumn(item_reason, F.when(repeat, F.lit(label)).otherwise(F.col(item_reason))).drop("_first")


def ranked_top(df: DataFrame, order: Sequence[Column | str], n: int, name: str = "rank") -> DataFrame:
    """The n best rows with their rank; the window only sees those n rows."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def running_best(df: DataFrame, run: str, order: Sequence[str], metric: str, target: float, patience: int) -> DataFrame:
    """Best so far, steps since it improved, target reached, early stop."""
    df, known = measured(df, [run])
    rows = positions(df, [run], list(order), "step", known)
    best = F.when(F.col(metric).isNotNull(), F.struct(F.col(metric).alias("v"), F.col("step").alias("at")))
    out = running(rows, [run], ["step"], {"_best": ("min", best)}, known)
    since = F.col("step") - F.col("_best.at")
    return out.withColumns(
        {
            "best": F.col("_best.v"),
            "is_best": F.coalesce(F.col("_best.at") == F.col("step"), F.lit(False)),
            "since_best": since,
            "reached": F.coalesce(F.col(metric) <= target, F.lit(False)),
            "stop": F.coalesce(since >= patience, F.lit(False)),
        }
    ).drop("_best")


def latest_state(df: DataFrame, run: str, order: Sequence[str], metric: str, target: float) -> DataFrame:
    """Latest and best value per run, and whether the target was ever reached."""
    at = F.struct(*order)
    return df.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_steps"), F.max_by(metric, at).alias("latest"), F.min(metric).alias("best"),
        F.coalesce(F.bool_or(F.col(metric) <= target), F.lit(False)).alias("reached"),
    )


def moving_error(df: DataFrame, keys: Sequence[str], step: Sequence[str], error: str, momentum: float) -> DataFrame:
    """Final exponential moving average of the step means, in closed form.

    The first step has weight m^(T-1), step k > 1 has (1-m) m^(T-k): powers of
    the distance to the end, so nothing overflows and plain sums do.
    """
    batches = df.groupBy(*keys, *step).agg(F.avg(F.abs(error)).alias("_e"))
    known = batches.count()
    placed = positions(batches, list(keys), list(step), "_k", known)
    rows = attach(placed, list(keys), {"_t": F.max("_k")}, known)
    decay = F.pow(F.lit(momentum), (F.col("_t") - F.col("_k")).cast("double"))
    weight = F.when(F.col("_k") == 1, decay).otherwise(decay * (1.0 - momentum))
    return rows.groupBy(*keys).agg(F.sum(weight * F.col("_e")).alias("moving_error"), F.max("_t").alias("n_updates"))


def select_k(df: DataFrame, vector: str, y: str, k: int) -> DataFrame:
    """k vector entries with the highest univariate F value."""
    stats = df.select(F.col(y).cast("double").alias("_y"), F.posexplode(vector).alias("dim", "_v")).groupBy("dim").agg(
        F.corr("_v", "_y").alias("r"), F.count(F.when(F.col("_v").isNotNull() & F.col("_y").isNotNull(), 1)).alias("n")
    )
    r2 = F.col("r") * F.col("r")
    scored = stats.withColumn("f", r2 / F.greatest(1.0 - r2, F.lit(1e-15)) * (F.col("n") - 2))
    return scored.filter("f IS NOT NULL").orderBy(F.desc("f"), "dim").limit(k)
