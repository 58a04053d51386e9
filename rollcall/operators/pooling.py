"""Item predictions to entity predictions.

Each method is a chain of partial aggregations; per-entity values go back to
the items through the counted lookup join.  No entity's items are ever gathered
in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions.numbers import ratio
from rollcall.functions.quality import distance_band, uncertainty_temper
from rollcall.operators.grouped import attach, attach_quantile, measured, same_keys

EPS = 1e-6


def _weighted(value: str, w: Column) -> Column:
    return F.sum(w * F.col(value)) / F.greatest(F.sum(w), F.lit(EPS))


def voting(df: DataFrame, value: str, *more: Column) -> DataFrame:
    """Items that have everything a method needs."""
    rows = df.filter(F.col(value).isNotNull())
    for column in more:
        rows = rows.filter(column.isNotNull())
    return rows


def pool_weighted(df: DataFrame, entity: str, value: str, weight: Column) -> DataFrame:
    """Weighted mean; unweighted population variance, 0 for a single item."""
    return voting(df, value, weight).groupBy(entity).agg(
        _weighted(value, weight).alias("mean"), F.var_pop(value).alias("var"), F.count(F.lit(1)).alias("n")
    )


def pool_inverse_variance(df: DataFrame, entity: str, value: str, weight: Column, var: Column) -> DataFrame:
    """Weights quality / variance; the variance is one over their sum."""
    w = F.greatest(weight / F.greatest(var, F.lit(EPS)), F.lit(EPS))
    return voting(df, value, weight, var).groupBy(entity).agg(
        _weighted(value, w).alias("mean"), (1.0 / F.greatest(F.sum(w), F.lit(EPS))).alias("var"), F.count(F.lit(1)).alias("n")
    )


def pool_attention(df: DataFrame, entity: str, value: str, weight: Column, var: Column, known: int | None = None) -> DataFrame:
    """Softmax of quality / variance over the entity's items, shifted by its maximum."""
    scored = voting(df, value, weight, var).select(entity, value, (weight / (var + EPS)).alias("_s"))
    if known is None:
        scored, known = measured(scored, [entity])
    rows = attach(scored, [entity], {"_top": F.max("_s")}, known)
    a = F.exp(F.col("_s") - F.col("_top"))
    v = F.col(value)
    sums = rows.groupBy(entity).agg(
        F.sum(a).alias("_a"), F.sum(a * v).alias("_av"), F.sum(a * v * v).alias("_avv"), F.count(F.lit(1)).alias("n")
    )
    mean = F.col("_av") / F.col("_a")
    spread = F.greatest(F.col("_avv") / F.col("_a") - mean * mean, F.lit(0.0))
    return sums.select(entity, mean.alias("mean"), F.when(F.col("n") > 1, spread).otherwise(F.lit(0.0)).alias("var"), "n")


def with_deviation(df: DataFrame, keys: Sequence[str], value: str, lower: bool, known: int) -> DataFrame:
    """Adds the group median ``_med``, |value - median| ``_dev`` and its median ``_mad``."""
    rows = attach_quantile(df, keys, "_med", value, 0.5, lower, known)
    rows = rows.withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    return attach_quantile(rows, keys, "_mad", "_dev", 0.5, lower, known)


def modified_z() -> Column:
    return F.col("_dev") * 0.6745 / F.greatest(F.col("_mad"), F.lit(1e-4))


def pool_robust(
    df: DataFrame, entity: str, value: str, reliability: Column, var: Column | None = None,
    max_z: float = 2.5, min_survivors: int = 3, delta_scale: float = 1.25, min_delta: float = 1.5, known: int | None = None,
) -> DataFrame:
    """Outlier rejection by modified z, then a centre from two Huber reweightings.

    While every entity fits a task, all steps are windows over the same key and
    share one shuffle; otherwise each step is an aggregate that is joined back.
    """
    df = voting(df, value, reliability) if var is None else voting(df, value, reliability, var)
    base = F.greatest(reliability, F.lit(EPS))
    noise = F.greatest(var, F.lit(EPS)) if var is not None else F.lit(0.0)
    if var is not None:
        base = F.greatest(base * uncertainty_temper(F.sqrt(noise)), F.lit(EPS))
    rows = df.select(entity, F.col(value).alias("_v"), base.alias("_w"), noise.alias("_noise"))
    if known is None:
        rows, known = measured(rows, [entity])
    rows = with_deviation(rows, [entity], "_v", True, known).withColumn("_in", modified_z() <= max_z)
    rows = attach(rows, [entity], {"_ok": F.count_if("_in"), "_total": F.count(F.lit(1))}, known)
    kept = rows.filter(F.col("_in") | (F.col("_ok") < min_survivors)).select(entity, "_v", "_w", "_noise", "_total")

    v = F.col("_v")
    kept = attach(kept, [entity], {"_sum": F.sum("_w"), "_wv": F.sum(F.col("_w") * v)}, known)
    kept = kept.withColumn("_c", F.col("_wv") / F.col("_sum")).withColumn("_dev", F.abs(v - F.col("_c")))
    kept = attach_quantile(kept, [entity], "_mad", "_dev", 0.5, True, known).select(
        entity, "_v", "_noise", "_total", (F.col("_w") / F.greatest(F.col("_sum"), F.lit(EPS))).alias("_w"), "_c",
        F.greatest(F.lit(min_delta), F.col("_mad") * delta_scale).alias("_delta"),
    )

    def reweighted(c: str) -> Column:
        gap = F.greatest(F.abs(v - F.col(c)), F.lit(EPS))
        return F.greatest(F.col("_w") * F.least(F.lit(1.0), F.col("_delta") / gap), F.lit(EPS))

    w1 = reweighted("_c")
    kept = attach(kept, [entity], {"_s1": F.sum(w1), "_s1v": F.sum(w1 * v)}, known).withColumn("_c1", F.col("_s1v") / F.col("_s1"))
    w2 = reweighted("_c1")
    # deviations are taken from the previous centre, so the squares stay small
    gap = v - F.col("_c1")
    final = kept.groupBy(entity).agg(
        F.sum(w2).alias("_s"), F.sum(w2 * gap).alias("_sg"), F.sum(w2 * gap * gap).alias("_sgg"),
        F.sum(w2 * F.col("_noise")).alias("_sn"), F.max("_c1").alias("_c1"), F.count(F.lit(1)).alias("surviving"), F.max("_total").alias("_total"),
    )
    shift = F.col("_sg") / F.col("_s")
    dispersion = F.greatest(F.col("_sgg") / F.col("_s") - shift * shift, F.lit(0.0))
    return final.select(
        entity, (F.col("_c1") + shift).alias("mean"),
        F.greatest(dispersion + F.col("_sn") / F.col("_s"), F.lit(EPS)).alias("var"),
        "surviving", (F.col("_total") - F.col("surviving")).alias("rejected"),
    )


def pool_evidence(
    df: DataFrame, keys: Sequence[str], value: str, var: str, quality: Column,
    max_var: float = 25.0, max_z: float = 1.5, target_std: float = 2.5, min_items: int = 2, inflation: float = 1.5, known: int | None = None,
) -> DataFrame:
    """Entity estimate with abstention: noisy and inconsistent items do not count.

    Where no item that counts has any quality the mean is NaN; an item without variance makes the deviation 0.
    """
    rows = df.select(*keys, F.col(value).alias("_v"), F.col(var).alias("_var"), quality.alias("_q"))
    if known is None:
        rows, known = measured(rows, keys)
    # values of items that are too noisy are blanked, so one pass keeps the totals too
    usable = F.col("_var") <= max_var
    rows = rows.withColumns({"_v": F.when(usable, F.col("_v")), "_use": F.coalesce(usable, F.lit(False))})
    rows = with_deviation(rows, keys, "_v", False, known)
    ok = F.col("_use") & (modified_z() <= max_z)
    w = F.when(ok, F.col("_q") / (F.col("_var") + EPS))
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if("_use").alias("_valid"), F.count_if(ok).alias("_kept"), F.max("_med").alias("_med"),
        F.avg(F.when(F.col("_use"), F.sqrt("_var"))).alias("_std"), ratio(F.sum(w * F.col("_v")), F.sum(w)).alias("_mean"),
        F.sqrt(F.lit(inflation) / F.sum(F.when(ok, ratio(F.lit(1.0), F.col("_var"))))).alias("_pooled_std"),
    )
    few = F.col("_valid") < min_items
    mixed = ~few & (F.col("_kept") < min_items)
    std = F.when(few, F.lit(0.0)).when(mixed, F.col("_std")).otherwise(F.col("_pooled_std"))
    sure = ~few & ~mixed & (F.col("_pooled_std") <= target_std)
    count = lambda c: F.col(c).cast("string")
    # fixed values: message texts
    message = (
        F.when(few, F.concat(F.lit("Insufficient clips passed variance/quality check ("), count("_valid"), F.lit("/"), count("n_total"), F.lit(")")))
        .when(mixed, "Inconsistent evidence cluster. Median fallback used.")
        .when(sure, "High confidence prediction")
        .otherwise(F.format_string("Uncertainty (±%.2fcm) above target", F.col("_pooled_std")))
    )
    return out.select(
        *keys,
        F.when(few, F.lit(0.0)).when(mixed, F.col("_med")).otherwise(F.col("_mean")).alias("mean"),
        std.alias("std"),
        F.when(few, F.col("_valid")).otherwise(F.col("_kept")).alias("n_accepted"),
        "n_total",
        sure.alias("is_confident"),
        F.when(sure, "SUCCESS").otherwise("ABSTAIN").alias("status"),
        message.alias("message"),
    )


METHODS = ("mean", "inverse_variance", "attention", "robust")
# Other accepted method names.
ALIASES = {
    "legacy_inverse_variance": "inverse_variance", "attention_weighted": "attention",
    "omega_robust_reliability_pool": "robust", "weighted": "mean",
}


def pool(df: DataFrame, method: str, entity: str, value: str, weight: Column, var: Column) -> DataFrame:
    """Pool by method name."""
    name = ALIASES.get(method, method)
    if name == "mean":
        return pool_weighted(df, entity, value, weight)
    if name == "inverse_variance":
        return pool_inverse_variance(df, entity, value, weight, var)
    if name == "attention":
        return pool_attention(df, entity, value, weight, var)
    if name == "robust":
        return pool_robust(df, entity, value, weight, var)
    raise ValueError(f"unknown pooling method {method!r}; known: {', '.join(METHODS)}")


def group_majority(df: DataFrame, entity: str, label: str) -> DataFrame:
    """Most frequent label; the smallest one on ties."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(entity, label).agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy(entity).agg(F.min(F.struct((-F.col("_n")).alias("v"), F.col(label).alias("l"))).alias("_b"), F.sum("_n").alias("n"))
    return best.select(entity, F.col("_b.l").alias(label), (-F.col("_b.v")).alias("votes"), "n")


def first_truth(df: DataFrame, entity: str, value: str, order: Sequence[str], means: Sequence[str]) -> DataFrame:
    """First non-missing value in item order; means of other fields."""
    place = F.when(F.col(value).isNotNull(), F.struct(*order))
    return df.groupBy(entity).agg(F.min_by(value, place).alias(value), *[F.avg(m).alias(m) for m in means])


def class_pool(df: DataFrame, entity: str, label: str, prob: str, weight: str) -> DataFrame:
    """Weighted class probabilities per entity; the most probable class (smallest on ties)."""
    per = df.groupBy(entity, label).agg((F.sum(F.col(prob) * F.col(weight)) / F.sum(weight)).alias("_p"))
    best = per.groupBy(entity).agg(F.min(F.struct((-F.col("_p")).alias("v"), F.col(label).alias("l"))).alias("_b"))
    return best.select(entity, F.col("_b.l").alias("predicted"), (-F.col("_b.v")).alias("prob"))


def pass_summary(df: DataFrame, item: str, mean: str, log_var: str) -> DataFrame:
    """Repeated stochastic predictions: mean, epistemic, aleatoric and total variance."""
    out = df.groupBy(item).agg(
        F.avg(mean).alias("mean"), F.var_pop(mean).alias("epistemic"), F.avg(F.exp(log_var)).alias("aleatoric"), F.count(F.lit(1)).alias("n_passes")
    )
    return out.withColumn("total", F.col("epistemic") + F.col("aleatoric"))


def quality_rollup(df: DataFrame, entity: str, fields: Sequence[str], weight: str, ok: str, warnings: str, distance: str) -> DataFrame:
    """Weighted means over present values, all-ok flag, band, sorted union of warnings.

    Warnings are made distinct per entity before they are listed, so the list is
    bounded by the number of warning kinds.
    """
    w = F.greatest(F.col(weight), F.lit(EPS))
    means = [
        (F.sum(w * F.col(f)) / F.sum(F.when(F.col(f).isNotNull(), w))).alias(f) for f in fields
    ]
    basic = df.groupBy(entity).agg(*means, F.bool_and(F.coalesce(ok, F.lit(True))).alias("all_ok"))
    told = df.select(entity, F.explode(warnings).alias("_x")).distinct()
    union = told.groupBy(entity).agg(F.array_join(F.array_sort(F.collect_list("_x")), "|").alias("warnings"))
    out = same_keys(basic, union, [entity], "left")
    return out.withColumns({"warnings": F.coalesce("warnings", F.lit("")), "band": distance_band(F.col(distance))})


def evidence_curve(
    df: DataFrame, entity: str, order: Sequence[str], y: str, value: str, var: str, sizes: Sequence[int] = (1, 3, 5, 10)
) -> DataFrame:
    """Error of the pooled estimate from the first N items, for several N.

    The per-entity limit keeps at most ``max(sizes)`` items before the shuffle,
    so the windows that follow see few rows per entity.
    """
    top = max(sizes)
    scope = Window.partitionBy(entity).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(scope)).filter(F.col("_rank") <= top)
    ranked = ranked.withColumn("_have", F.max("_rank").over(Window.partitionBy(entity)))
    grid = F.filter(F.array(*[F.lit(n) for n in sizes]), lambda n: (n >= F.col("_rank")) & ((F.col("_have") >= n) | (n == 1)))
    rows = ranked.withColumn("n_items", F.explode(grid))
    # the target is constant within an entity: keep it as part of the key
    pooled = pool_evidence(rows, ["n_items", entity, y], value, var, F.lit(1.0), known=top)
    usable = (F.col("status") == "SUCCESS") | ((F.col("n_items") == 1) & (F.col("mean") > 0))
    return pooled.groupBy("n_items").agg(
        F.count(F.lit(1)).alias("n_entities"), F.count_if(usable).alias("n_used"),
        F.avg(F.when(usable, F.abs(F.round("mean", 2) - F.col(y)))).alias("mae"),
    )
