"""Metrics over predictions, in long form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.operators.grouped import group_quantiles
from rollcall.session import settle


def error_columns(df: DataFrame, y: str, pred: str) -> DataFrame:
    err = F.col(pred) - F.col(y)
    return df.withColumns({"_err": err, "_abs": F.abs(err)}).filter(F.col("_abs").isNotNull())


def error_aggregates(y: str, within: Sequence[float] = (2.0, 3.0, 4.0, 5.0)) -> dict[str, Column]:
    """Everything about the errors that one map-side combined pass can give."""
    e, a = F.col("_err"), F.col("_abs")
    square = F.sum(e * e)
    n = F.count(F.lit(1))
    return {
        "n": n,
        "mae": F.avg(a),
        "rmse": F.sqrt(F.avg(e * e)),
        "max_ae": F.max(a),
        "bias": F.avg(e),
        **{f"within_{w:g}": F.avg((a <= w).cast("double")) for w in within},
        "r2": F.when((n > 1) & (F.var_pop(y) > 0), 1.0 - square / (n * F.var_pop(y))),
    }


def regression_metrics(
    df: DataFrame, keys: Sequence[str], y: str, pred: str, more: Mapping[str, Column] | None = None, known: int | None = None
) -> DataFrame:
    """One row of metrics per group; medians and p90 are exact."""
    extra = [c for c in df.columns if c not in (*keys, y, pred)] if more else []
    errors = error_columns(df.select(*keys, y, pred, *extra), y, pred)
    aggs = {**error_aggregates(y), **(more or {})}
    return group_quantiles(errors, keys, "_abs", {"median_ae": 0.5, "p90_ae": 0.9}, aggs=aggs, known=known)


def slice_rows(df: DataFrame, slices: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """One row per row and slice dimension; rows without a value are not in that slice."""
    pairs = F.array(*[F.struct(F.lit(d).alias("slice_dim"), v.cast("string").alias("slice_value")) for d, v in slices.items()])
    return (
        df.select(*keep, F.explode(pairs).alias("_s"))
        .select(*keep, "_s.slice_dim", "_s.slice_value")
        .filter(F.col("slice_value").isNotNull())
    )


def sliced_metrics(
    df: DataFrame, slices: Mapping[str, Column], y: str, pred: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Metrics overall and for every value of every slice.

    The rows are dealt to all tasks and written once, before they are repeated for every slice.
    """
    named = {f"_s{i}": c for i, c in enumerate(slices.values())}
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    rows = settle(df.select(*keys, y, pred, *[c.alias(n) for n, c in named.items()]).repartition(tasks))
    long = slice_rows(rows, {"all": F.lit("all"), **{d: F.col(n) for d, n in zip(slices, named, strict=True)}}, [*keys, y, pred])
    return regression_metrics(long, [*keys, "slice_dim", "slice_value"], y, pred)


def finite_candidates(df: DataFrame, candidate: str, pred: str) -> DataFrame:
    """Candidates with counts of unusable predictions; any one rules the candidate out."""
    p = F.col(pred)
    bad = p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))
    return df.groupBy(candidate).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_bad"), (F.count_if(bad) == 0).alias("usable")
    )


def edge_metrics(df: DataFrame, keys: Sequence[str], y: str, pred: str, low: float = 160.0, high: float = 175.0) -> DataFrame:
    """Mean and worst of the two edge errors."""
    errors = error_columns(df, y, pred)
    out = errors.groupBy(*keys).agg(
        F.avg(F.when(F.col(y) < low, F.col("_abs"))).alias("short_mae"),
        F.avg(F.when(F.col(y) >= high, F.col("_abs"))).alias("tall_mae"),
    )
    both = F.array_compact(F.array("short_mae", "tall_mae"))
    total = F.aggregate(both, F.lit(0.0), lambda a, x: a + x)
    return out.withColumns(
        {"edge_mae": total / F.nullif(F.size(both), F.lit(0)), "edge_worst_mae": F.greatest("short_mae", "tall_mae")}
    )


# Weights of the guarded score.
GUARD_WEIGHTS = {("target", "short"): 0.35, ("quality", "medium"): 0.20, ("target", "tall"): 0.10}
BALANCED = (("all", "all"), ("target", "short"), ("target", "medium"), ("target", "tall"))


def guard_metrics(sliced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Balanced and guarded score from a long slice table with ``mae``."""
    def value(dim: str, name: str) -> Column:
        return F.max(F.when((F.col("slice_dim") == dim) & (F.col("slice_value") == name), F.col("mae")))

    wanted = dict.fromkeys((*BALANCED, *GUARD_WEIGHTS))
    wide = sliced.groupBy(*keys).agg(*[value(d, n).alias(f"{d}_{n}") for d, n in wanted])
    balanced = F.array_compact(F.array(*[F.col(f"{d}_{n}") for d, n in BALANCED]))
    guarded = F.col("all_all")
    for (d, n), weight in GUARD_WEIGHTS.items():
        guarded = guarded + F.coalesce(F.greatest(F.col(f"{d}_{n}") - F.col("all_all"), F.lit(0.0)) * weight, F.lit(0.0))
    mean = F.aggregate(balanced, F.lit(0.0), lambda a, x: a + x) / F.size(balanced)
    return wide.select(*keys, F.col("all_all").alias("overall"), mean.alias("balanced"), guarded.alias("guarded"))


def confusion(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.groupBy(y, pred).agg(F.count(F.lit(1)).alias("n"))


def classification(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class, plus overall accuracy.

    Built on the confusion counts, so its size is classes squared.
    """
    cells = confusion(df, y, pred)
    sides = F.array(
        F.struct(F.col(y).alias("cls"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")),
        F.struct(F.col(pred).alias("cls"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")),
    )
    hit = F.when(F.col(y) == F.col(pred), F.col("n")).otherwise(0)
    per = (
        cells.withColumn("hit", hit / 2)
        .select("hit", F.explode(sides).alias("s"))
        .groupBy("s.cls")
        .agg(F.sum("s.t").alias("support"), F.sum("s.p").alias("n_pred"), F.sum("hit").alias("hits"))
    )
    accuracy = cells.agg((F.sum(hit) / F.sum("n")).alias("acc"))
    precision = F.col("hits") / F.nullif(F.col("n_pred"), F.lit(0))
    recall = F.col("hits") / F.nullif(F.col("support"), F.lit(0))
    return per.select(
        "cls", "support",
        F.coalesce(precision, F.lit(0.0)).alias("precision"),
        F.coalesce(recall, F.lit(0.0)).alias("recall"),
        (2.0 * F.col("hits") / (F.col("n_pred") + F.col("support"))).alias("f1"),
        accuracy.select("acc").scalar().alias("accuracy"),
    )


def calibration_metrics(df: DataFrame, keys: Sequence[str], y: str, pred: str, std: str) -> DataFrame:
    """Do the stated uncertainties match the errors?"""
    errors = error_columns(df, y, pred).withColumn("_std", F.greatest(F.col(std), F.lit(1e-6)))
    errors = errors.filter(F.col(std).isNotNull())
    a, s = F.col("_abs"), F.col("_std")
    varies = (F.stddev_pop(a) > 1e-12) & (F.stddev_pop(s) > 1e-12)
    return errors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(s - a)).alias("calibration_mae"),
        F.when(varies, F.corr(s, a)).alias("error_corr"),
        F.avg((a <= s).cast("double")).alias("interval_68"),
        F.avg((a <= s * 1.96).cast("double")).alias("interval_95"),
        F.avg(s).alias("std_mean"),
    )


def multi_seed(df: DataFrame, variant: str, run: str, metric: str, value: str) -> DataFrame:
    """Mean and population sd (0 for one run) of every metric per variant."""
    return df.groupBy(variant, metric).agg(
        F.count_distinct(run).alias("n_runs"),
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("std"),
    )


def overfit_gap(metrics: DataFrame, keys: Sequence[str], split: str, value: str) -> DataFrame:
    """Validation minus train."""
    wide = metrics.groupBy(*keys).agg(
        *[F.max(F.when(F.col(split) == s, F.col(value))).alias(s) for s in ("train", "val")]
    )
    return wide.withColumn("gap", F.col("val") - F.col("train"))


def slice_spread(sliced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest minus smallest slice error per dimension with two slices or more."""
    return (
        sliced.filter("slice_dim <> 'all' AND mae IS NOT NULL")
        .groupBy(*keys, "slice_dim")
        .agg((F.max("mae") - F.min("mae")).alias("spread"), F.count(F.lit(1)).alias("n_slices"))
        .filter("n_slices >= 2")
    )


def worst_degradation(sliced: DataFrame, method: str, old: str, new: str) -> DataFrame:
    """Largest rise of a slice error from the old to the new method."""
    wide = (
        sliced.filter("slice_dim <> 'all'")
        .groupBy("slice_dim", "slice_value")
        .agg(*[F.max(F.when(F.col(method) == m, F.col("mae"))).alias(n) for m, n in ((old, "a"), (new, "b"))])
    )
    return wide.agg(F.max(F.col("b") - F.col("a")).alias("worst_degradation"))


def error_budget(df: DataFrame, y: str, pred: str, target: float, slice_: Column) -> DataFrame:
    """Total error, what the target allows, and the mean error were the slice perfect."""
    errors = error_columns(df, y, pred)
    a, n = F.col("_abs"), F.count(F.lit(1))
    total = F.sum(a)
    inside = F.coalesce(F.sum(F.when(slice_, a)), F.lit(0.0))
    return errors.agg(
        n.alias("n"), total.alias("total_error"), (n * target).alias("budget"), (total - n * target).alias("gap"),
        inside.alias("slice_error"), ((total - inside) / n).alias("mae_if_slice_perfect"),
    )
