"""Group-wise primitives that stay exact when one group is huge.

Every function here first measures what it is about to do.  If the largest
group fits one task, the plain window or ``percentile`` is used.  If not, the
rows are range-partitioned on (group, order), each slice is worked on alone and
the slices are put together with per-slice totals, so that no task ever holds
more than its slice.  Tables are broadcast only when their rows were counted.

``known`` is an upper bound on the rows of the input that the caller has already
counted, or the ``GroupBound`` that ``measured`` found.  No group and no per-group table can have more rows than that, so a
small bound saves the other measurements.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.session import settle, settle_counted

#: rows of one group that one task may sort or hold in memory
GROUP_ROWS = 1_000_000
#: rows of one slice of a group that is cut up
SLICE_ROWS = 20_000_000
#: rows of a table that may be sent to every executor
BROADCAST_ROWS = 200_000
#: equal parts of a group's span in which quantiles are looked for first
BUCKETS = 4096


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the biggest group: one map-side combined count."""
    if not keys:
        return df.count()
    top = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return int(top["n"] or 0)


class GroupBound(int):
    """Rows of the largest group, measured once on a table of which all later inputs are a part."""


def measured(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, GroupBound]:
    """The rows and the size of their largest group; settled if a group is too large for a task.

    Filters and added columns only shrink groups, so a chain of steps on the same keys
    needs no other measurement.
    """
    bound = GroupBound(largest_group(df, keys))
    return (settle(df) if bound > GROUP_ROWS else df), bound


def fits_task(df: DataFrame, keys: Sequence[str], known: int | None = None, limit: int | None = None) -> bool:
    """Can every group be held by one task?"""
    limit = GROUP_ROWS if limit is None else limit
    if known is not None and known <= limit:
        return True
    if isinstance(known, GroupBound):
        return False
    return largest_group(df, keys) <= limit


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join that also matches NULL keys; key columns are kept once."""
    other = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    cond: Column = F.lit(True)
    for key in keys:
        cond = cond & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    return left.join(other, cond, how).drop(*[f"_r_{k}" for k in keys])


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    known: int | None = None,
) -> DataFrame:
    """Bring per-group values to the rows.

    With a small ``known`` bound on the table it is broadcast as it is;
    otherwise it is settled and counted.  Small: broadcast.  Large: shuffle
    join, with the rows of hot groups cut into slices and the table row repeated
    once per slice (there are at most ``rows / GROUP_ROWS`` hot groups).
    """
    if not keys:
        return rows.withColumns({c: table.select(c).scalar() for c in table.columns})
    if known is not None and known <= BROADCAST_ROWS:
        return same_keys(rows, F.broadcast(table), keys, how)
    table, size = settle_counted(table)
    if size <= BROADCAST_ROWS:
        return same_keys(rows, F.broadcast(table), keys, how)
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > GROUP_ROWS)
    hot, n_hot = settle_counted(hot.select(*keys, F.ceil(F.col("_n") / GROUP_ROWS).cast("int").alias("_cuts")))
    if n_hot == 0:
        return same_keys(rows, table, keys, how)
    if n_hot <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    plain = [c for c, t in rows.dtypes if not t.startswith("map")]
    cut_rows = same_keys(rows, hot, keys, "left").withColumn(
        "_cut", F.pmod(F.xxhash64(*plain), F.coalesce("_cuts", F.lit(1))).cast("int")
    )
    cut_table = same_keys(table, hot, keys, "left").withColumn(
        "_cut", F.explode(F.sequence(F.lit(0), F.coalesce("_cuts", F.lit(1)) - 1))
    )
    joined = same_keys(cut_rows.drop("_cuts"), cut_table.drop("_cuts"), [*keys, "_cut"], how)
    return joined.drop("_cut")


def attach(rows: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column], known: int | None = None) -> DataFrame:
    """Per-group aggregates on every row; ``aggs`` holds plain aggregate calls.

    Groups that fit a task are windowed: operators chained on the same keys then
    share one shuffle.  Otherwise the aggregates are joined back.
    """
    if keys and fits_task(rows, keys, known):
        scope = Window.partitionBy(*keys)
        return rows.withColumns({n: c.over(scope) for n, c in aggs.items()})
    table = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return lookup_join(rows, table, keys)


def quantile_agg(value: str, p: float, lower: bool = False) -> Column:
    """Exact quantile as an aggregate of one task: linear, or the lower value."""
    if lower:
        return F.expr(f"percentile_disc({p}D) WITHIN GROUP (ORDER BY {value})")
    return F.percentile(value, F.lit(float(p)))


def attach_quantile(
    rows: DataFrame, keys: Sequence[str], name: str, value: str, p: float, lower: bool = False, known: int | None = None
) -> DataFrame:
    """A per-group quantile on every row."""
    if keys and fits_task(rows, keys, known):
        return rows.withColumn(name, quantile_agg(value, p, lower).over(Window.partitionBy(*keys)))
    return lookup_join(rows, group_quantiles(rows, keys, value, {name: p}, lower, known=known), keys)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    columns: Mapping[str, tuple[str, Column]],
    known: int | None = None,
) -> DataFrame:
    """Running sum/min/max per group, current row included.

    ``columns`` maps an output name to ``(kind, column)`` with kind one of
    ``sum``, ``min``, ``max``.  ``order`` must be total within a group.
    """
    kinds = {"sum": F.sum, "min": F.min, "max": F.max}
    # a sum is NULL only while nothing has been summed, in this slice or before it
    both = lambda a, b: F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    folds = {"sum": both, "min": F.least, "max": F.greatest}
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if fits_task(df, keys, known):
        scope = upto(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order))
        return df.withColumns({n: kinds[k](c).over(scope) for n, (k, c) in columns.items()})
    total = df.count() if known is None or isinstance(known, GroupBound) else known
    slices = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SLICE_ROWS))
    ranged = settle(
        df.repartitionByRange(slices, *keys, *order).withColumn("_part", F.spark_partition_id())
    )
    totals = ranged.groupBy(*keys, "_part").agg(
        *[kinds[k](c).alias(f"_t_{n}") for n, (k, c) in columns.items()]
    )
    earlier = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *keys,
        "_part",
        *[kinds[k](f"_t_{n}").over(earlier).alias(f"_o_{n}") for n, (k, _) in columns.items()],
    )
    scope = upto(Window.partitionBy(*keys, "_part").orderBy(*order))
    local = ranged.withColumns({n: kinds[k](c).over(scope) for n, (k, c) in columns.items()})
    joined = lookup_join(local, offsets, [*keys, "_part"])
    return joined.withColumns(
        {n: folds[k](F.col(n), F.col(f"_o_{n}")) for n, (k, _) in columns.items()}
    ).drop("_part", *[f"_o_{n}" for n in columns])


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    name: str = "pos",
    known: int | None = None,
) -> DataFrame:
    """1-based place of each row in its group."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("long"))}, known)


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """First n rows per group; Spark limits each group before the shuffle."""
    scope = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(scope)).filter(F.col("_rank") <= n).drop("_rank")


def _places(p: float, lower: bool) -> tuple[Column, Column, Column]:
    """Place of a quantile among ``_size`` values from 0, and the whole places below and above."""
    place = F.ceil(F.col("_size") * F.lit(p)) - 1 if lower else (F.col("_size") - 1) * F.lit(p)
    return place, F.greatest(F.floor(place), F.lit(0)), F.greatest(F.ceil(place), F.lit(0))


def _near_quantiles(
    data: DataFrame, spans: DataFrame, n_groups: int, keys: Sequence[str], probs: Mapping[str, float], lower: bool
) -> DataFrame:
    """Distinct values ``_v`` of the buckets that hold the wanted places, with ``_cum``, the rows up to them.

    Values are counted by bucket (a monotone function of the value) without a shuffle of
    rows; only the few buckets with a wanted place are counted by value.
    """
    span = F.col("_hi") / 2 - F.col("_lo") / 2
    part = F.least(F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / span * BUCKETS), F.lit(BUCKETS - 1))
    bucket = (
        F.when(F.isnan("_v"), BUCKETS + 1).when(F.col("_v") == float("inf"), BUCKETS).when(F.col("_v") == float("-inf"), -1)
        .when(span > 0, part).otherwise(0).cast("int")
    )
    placed = lookup_join(data, spans.select(*keys, "_size", "_lo", "_hi"), keys, known=n_groups).withColumn("_b", bucket)
    upto = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = placed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"), F.max("_size").alias("_size"))
    parts = parts.withColumn("_upto", F.sum("_n").over(upto))
    holds = F.lit(False)
    for p in probs.values():
        for place in _places(p, lower)[1:]:
            holds = holds | ((place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_n")))
    wanted, n_wanted = settle_counted(parts.filter(holds).select(*keys, "_b", (F.col("_upto") - F.col("_n")).alias("_before")))
    near = lookup_join(placed.select(*keys, "_b", "_v", "_size"), wanted, [*keys, "_b"], "inner", known=n_wanted)
    counts, known = settle_counted(near.groupBy(*keys, "_b", "_before", "_size", "_v").agg(F.count(F.lit(1)).alias("_n")))
    ranked = running(counts, [*keys, "_b"], ["_v"], {"_cum": ("sum", F.col("_n"))}, known)
    return ranked.withColumn("_cum", F.col("_cum") + F.col("_before"))


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    lower: bool = False,
    aggs: Mapping[str, Column] | None = None,
    known: int | None = None,
) -> DataFrame:
    """Exact quantiles per group; one output column per entry of ``probs``.

    Linear interpolation, or with ``lower`` the smaller of the two middle values
    (no interpolation).  Rows whose value is NULL are left out, also of the
    further aggregates in ``aggs``.
    """
    aggs = dict(aggs or {})
    data = df.withColumn("_v", F.col(value).cast("double")).filter(F.col("_v").isNotNull())
    others = [c.alias(n) for n, c in aggs.items()]
    if fits_task(data, keys, known):
        return data.groupBy(*keys).agg(*[quantile_agg("_v", p, lower).alias(n) for n, p in probs.items()], *others)
    finite = F.when(F.abs("_v") < float("inf"), F.col("_v"))
    spans, n_groups = settle_counted(
        data.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi"), *others)
    )
    if n_groups <= BROADCAST_ROWS:
        ranked = _near_quantiles(data.select(*keys, "_v"), spans, n_groups, keys, probs, lower)
    else:
        counts = data.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
        ranked = running(counts, keys, ["_v"], {"_cum": ("sum", F.col("_n"))}, known)
        ranked = lookup_join(ranked, spans.select(*keys, "_size"), keys)
    picks = []
    for name, p in probs.items():
        place, low, high = _places(p, lower)
        picks += [
            F.min(F.when(F.col("_cum") > low, F.col("_v"))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_cum") > high, F.col("_v"))).alias(f"_hi_{name}"),
            F.max(place - F.floor(place)).alias(f"_fr_{name}"),
        ]
    found = ranked.groupBy(*keys).agg(*picks).select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_fr_{n}")).alias(n)
            for n in probs
        ],
    )
    if not others:
        return found
    return lookup_join(spans.select(*keys, *aggs), found, keys, known=n_groups)


def scalar(df: DataFrame, column: str) -> Column:
    """The single value of a one-row aggregate, as a scalar subquery."""
    return df.select(column).scalar()
