"""Calibrators: small parameter tables fitted on out-of-fold predictions.

A calibrator is fitted per ``keys`` (e.g. per recipe) and applied by joining its
parameter rows; parameters never depend on the rows they are applied to.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.numbers import bounded, bounded01, target_bin
from rollcall.operators.grouped import attach, attach_quantile, group_quantiles, lookup_join


@dataclass(frozen=True)
class Segment:
    """One piece of a piecewise calibrator: predictions of a group below an edge."""

    name: str
    group: int | None
    low: float | None
    high: float | None
    min_rows: int
    slope_low: float
    slope_high: float
    flat_slope: float = 1.0
    flat_shift: float = 0.0
    default: tuple[float, float] | None = None
    ramp: float | None = None
    shift: float | None = None


# Edges, row minima and slope limits of the piecewise calibrators.
SEGMENTS: dict[str, tuple[Segment, ...]] = {
    "gender_affine": (
        Segment("0", 0, None, None, 5, 0.7, 1.8),
        Segment("1", 1, None, None, 5, 0.7, 1.8),
    ),
    "range_affine": (
        Segment("short", None, None, 165.0, 4, 0.5, 2.0),
        Segment("medium", None, 165.0, 175.0, 4, 0.5, 2.0),
        Segment("tall", None, 175.0, None, 4, 0.5, 2.0),
    ),
    "short_gated": (Segment("short_gated", None, None, 165.0, 4, 0.6, 2.2),),
    "short_voice_calibrated": (Segment("short_voice", None, None, 168.0, 4, 0.7, 2.5, flat_slope=1.2, ramp=10.0),),
    "short_male_debias": (
        Segment("short_male", 1, None, 174.0, 3, 0.7, 2.8, flat_slope=1.2, default=(1.0, 0.0), ramp=10.0),
        Segment("short_female", 0, None, 165.0, 3, 0.6, 2.2, ramp=8.0),
    ),
    "short_physical_calibrated": (
        Segment("short_male_phys", 1, None, 175.0, 2, 0.8, 2.5, default=(1.0, 0.0), ramp=12.0, shift=4.0),
        Segment("short_female_phys", 0, None, 164.0, 2, 0.5, 2.0, ramp=10.0, shift=0.0),
    ),
}
OFFSET_KINDS = ("raw", "global", "group", "group_snap")
KINDS = (*OFFSET_KINDS, *SEGMENTS)


def segment_of(kind: str, pred: Column, group: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for s in SEGMENTS[kind]:
        test = pred.isNotNull()
        if s.group is not None:
            test = test & (group == s.group)
        if s.low is not None:
            test = test & (pred >= s.low)
        if s.high is not None:
            test = test & (pred < s.high)
        out = out.when(test, F.lit(s.name))
    return out


def segment_value(kind: str, field: str) -> Column:
    """A fixed field of the row's segment."""
    out = F.when(F.lit(False), F.lit(0.0))
    for s in SEGMENTS[kind]:
        value = getattr(s, field)
        if value is not None:
            out = out.when(F.col("segment") == s.name, F.lit(float(value)))
    return out


def fit_segments(df: DataFrame, kind: str, keys: Sequence[str], y: str, pred: str, group: str, known: int | None = None) -> DataFrame:
    """(keys, segment, slope, intercept) of the segments that have enough rows.

    The slope is the sample covariance over the population variance, limited;
    the intercept is the median of what the slope leaves.
    """
    rows = df.select(*keys, y, pred, segment_of(kind, F.col(pred), F.col(group)).alias("segment")).filter("segment IS NOT NULL")
    known = rows.count() if known is None else known
    by = [*keys, "segment"]
    stats = {"_n": F.count(F.lit(1)), "_var": F.var_pop(pred), "_cov": F.covar_samp(pred, y)}
    rows = attach(rows, by, stats, known).filter(F.col("_n") >= segment_value(kind, "min_rows"))
    limited = bounded(F.col("_cov") / F.col("_var"), segment_value(kind, "slope_low"), segment_value(kind, "slope_high"))
    slope = F.when(F.col("_var") > 1e-6, limited).otherwise(segment_value(kind, "flat_slope"))
    rows = rows.withColumn("_slope", slope).withColumn("_rest", F.col(y) - F.col("_slope") * F.col(pred))
    return group_quantiles(rows, by, "_rest", {"intercept": 0.5}, aggs={"n": F.max("_n"), "slope": F.max("_slope")}, known=known)


def apply_segments(
    df: DataFrame, params: DataFrame, kind: str, keys: Sequence[str], pred: str, group: str, out: str, known: int | None = None
) -> DataFrame:
    """Calibrated prediction; rows outside every segment, or in one without parameters, stay."""
    p = F.col(pred)
    rows = df.withColumn("segment", segment_of(kind, p, F.col(group)))
    bound = known if keys else len(SEGMENTS[kind])
    rows = lookup_join(rows, params.select(*keys, "segment", "slope", "intercept"), [*keys, "segment"], known=bound)
    defaults = {s.name: s.default for s in SEGMENTS[kind] if s.default}
    slope, intercept = F.col("slope"), F.col("intercept")
    for name, (a, b) in defaults.items():
        slope = F.when((F.col("segment") == name) & F.col("slope").isNull(), F.lit(a)).otherwise(slope)
        intercept = F.when((F.col("segment") == name) & F.col("slope").isNull(), F.lit(b)).otherwise(intercept)
    if any(s.shift is not None for s in SEGMENTS[kind]):
        value = p - slope * (segment_value(kind, "high") - p) - segment_value(kind, "shift")
    else:
        value = slope * p + intercept
    if any(s.ramp is not None for s in SEGMENTS[kind]):
        w = bounded((segment_value(kind, "high") - p) / segment_value(kind, "ramp"), 0.0, 1.0)
        value = (1.0 - w) * p + w * value
    return rows.withColumn(out, F.coalesce(value, p)).drop("segment", "slope", "intercept")


def fit_offsets(df: DataFrame, keys: Sequence[str], y: str, pred: str, source: str, group: str, known: int | None = None) -> DataFrame:
    """(keys, source, group, global_offset, group_offset): shrunken medians of the residuals."""
    rows = df.select(*keys, source, group, (F.col(y) - F.col(pred)).alias("_r"))
    known = rows.count() if known is None else known
    rows = attach_quantile(rows, keys, "_g", "_r", 0.5, known=known).withColumn("_c", F.col("_r") - F.col("_g"))
    by = [*keys, source, group]
    out = group_quantiles(rows, by, "_c", {"_m": 0.5}, aggs={"_n": F.count(F.lit(1)), "global_offset": F.max("_g")}, known=known)
    shrunk = F.col("_n") / (F.col("_n") + 20.0) * F.col("_m")
    return out.select(*by, "global_offset", F.when(F.col("_n") >= 5, shrunk).alias("group_offset"))


def snap(c: Column, grid: float = 2.54) -> Column:
    """Nearest grid point, halves to even."""
    return F.bround(c / F.lit(grid)) * F.lit(grid)


def apply_offsets(
    df: DataFrame, params: DataFrame, kind: str, keys: Sequence[str], pred: str, source: str, group: str, out: str,
    snapped: Sequence[str] = (), damped_group: int = 1, known: int | None = None,
) -> DataFrame:
    """Global offset plus group offset; ``group_snap`` damps it at low values and snaps some sources."""
    overall = params.groupBy(*keys).agg(F.max("global_offset").alias("_g"))
    rows = lookup_join(df, overall, keys, known=known)
    moved = F.col(pred) + F.coalesce("_g", F.lit(0.0))
    if kind == "global":
        return rows.withColumn(out, moved).drop("_g")
    rows = lookup_join(rows, params.select(*keys, source, group, "group_offset"), [*keys, source, group], known=known)
    offset = F.coalesce("group_offset", F.lit(0.0))
    if kind == "group_snap":
        low = (F.col(group) == damped_group) & (moved < 172.0) & (offset > 0)
        offset = F.when(low, offset * bounded01((moved - 162.0) / 10.0)).otherwise(offset)
        value = F.when(F.col(source).isin(*snapped), snap(moved + offset)).otherwise(moved + offset)
    else:
        value = moved + offset
    return rows.withColumn(out, value).drop("_g", "group_offset")


def fit(
    df: DataFrame, kind: str, keys: Sequence[str] = (), y: str = "y", pred: str = "pred", source: str = "source", group: str = "g",
    known: int | None = None,
) -> DataFrame | None:
    """Parameter table of a calibrator kind; None for ``raw``.

    ``known`` is the number of training rows, if the caller has counted them.
    """
    if kind == "raw":
        return None
    if kind in OFFSET_KINDS:
        return fit_offsets(df, list(keys), y, pred, source, group, known)
    if kind in SEGMENTS:
        return fit_segments(df, kind, list(keys), y, pred, group, known)
    raise ValueError(f"unknown calibrator {kind!r}; known: {', '.join(KINDS)}")


def apply(
    df: DataFrame, params: DataFrame | None, kind: str, keys: Sequence[str] = (), pred: str = "pred", source: str = "source",
    group: str = "g", out: str = "calibrated", snapped: Sequence[str] = (), known: int | None = None,
) -> DataFrame:
    """``known`` bounds the rows of the parameter table, e.g. by the training rows."""
    if params is None:
        return df.withColumn(out, F.col(pred))
    if kind in OFFSET_KINDS:
        return apply_offsets(df, params, kind, list(keys), pred, source, group, out, snapped, known=known)
    return apply_segments(df, params, kind, list(keys), pred, group, out, known)


def fit_linear(df: DataFrame, y: str, pred: str) -> tuple[Column, Column]:
    """(slope, intercept) of y on the prediction, as scalar subqueries."""
    line = df.agg(F.regr_slope(y, pred).alias("slope"), F.regr_intercept(y, pred).alias("intercept"))
    return line.select("slope").scalar(), line.select("intercept").scalar()


def fit_edge_offsets(df: DataFrame, y: str, pred: str, strength: float = 25.0, limit: float = 4.0) -> DataFrame:
    """(bin, offset): shrunken, limited median residual per predicted bin."""
    rows = df.select(target_bin(F.col(pred)).alias("bin"), (F.col(y) - F.col(pred)).alias("_r"))
    out = group_quantiles(rows, ["bin"], "_r", {"_m": 0.5}, aggs={"n": F.count(F.lit(1))})
    return out.select("bin", "n", bounded(F.col("_m") * F.col("n") / (F.col("n") + strength), -limit, limit).alias("offset"))


def apply_edge_offsets(df: DataFrame, offsets: DataFrame, pred: str, out: str) -> DataFrame:
    rows = lookup_join(df.withColumn("bin", target_bin(F.col(pred))), offsets.select("bin", "offset"), ["bin"], known=3)
    return rows.withColumn(out, F.col(pred) + F.coalesce("offset", F.lit(0.0))).drop("bin", "offset")


def hierarchical_prior(
    train: DataFrame, rows: DataFrame, levels: Sequence[Sequence[str]], y: str, out: str = "prior", strength: float = 12.0
) -> DataFrame:
    """Global median refined by nested group medians, each shrunk by n / (n + strength)."""
    known = train.count()
    base = group_quantiles(train, [], y, {"_m": 0.5}, known=known).select("_m").scalar()
    result = rows.withColumn(out, base)
    for level in levels:
        by = list(level)
        table = group_quantiles(train, by, y, {"_m": 0.5}, aggs={"_n": F.count(F.lit(1))}, known=known)
        result = lookup_join(result, table, by, known=known)
        w = F.col("_n") / (F.col("_n") + strength)
        result = result.withColumn(out, F.coalesce((1.0 - w) * F.col(out) + w * F.col("_m"), F.col(out))).drop("_n", "_m")
    return result
