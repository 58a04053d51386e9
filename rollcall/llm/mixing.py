"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.common import null_safe_key
from rollcall.operators.grouped import lookup_join
from rollcall.session import settle, settle_counted

#: bits of a hash, and bits that one histogram looks at
HASH_BITS, LEVEL_BITS = 60, 12


def n_words(text: Column) -> Column:
    """Words between ASCII white space; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash60(seed: str, column: Column) -> Column:
    """The first 60 bits of a seeded md5 as a number from 0 up."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), null_safe_key(column))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(key, source, source_size) -> the same with target: weights by code point order, NULL last.

    A target stops at ``cap`` times its source; what is over goes to the others by
    weight.  That is a water level: sources in order of cap over weight are full up to
    some place, all others stand at level times weight.  The tables here have one row
    per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("w", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("top") / F.col("w"), "rank_key")
    level = (
        ranked.withColumn("top", F.col("source_size") * F.lit(float(cap)))
        .withColumn("rank_key", F.col("key"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("full_before", F.coalesce(F.sum("top").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_from", F.sum("w").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("full_before")) / F.col("w_from"))
    )
    # the first source that its share does not fill sets the level of all after it
    water = level.withColumn("open", F.when(F.col("level") * F.col("w") < F.col("top"), F.col("level"))).withColumn(
        "water", F.first("open", ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    )
    target = F.when(F.col("water").isNull(), F.col("top")).otherwise(F.least("top", F.col("water") * F.col("w")))
    return water.select("key", "source", "source_size", target.alias("target"))


def boundary(rows: DataFrame, budgets: DataFrame, known: int) -> DataFrame:
    """Where each key's rows, in order of their hash, reach its budget.

    ``rows`` has (key, h, size), ``budgets`` (key, budget).  Returns (key, edge, whole):
    rows with h below ``edge`` are within the budget; ``whole`` tells whether the row at
    the edge itself brings the sum nearer.  Each round sums sizes by key and hash
    bucket, finds the bucket in which the budget ends, and looks only into that one.
    """
    state = budgets.select("key", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("before"), F.lit(0.0).alias("inside"))
    done = 0
    while done < HASH_BITS:
        shift = HASH_BITS - done - LEVEL_BITS
        within = lookup_join(rows, state.select("key", "prefix"), ["key"], "inner", known)
        if done:
            within = within.where(F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix"))
        sums = within.groupBy("key", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").cast("double").alias("inside_next"))
        upto = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        crossing = (
            lookup_join(sums.withColumn("upto", F.sum("inside_next").over(upto)), state, ["key"], "inner", known)
            .where(F.col("before") + F.col("upto") > F.col("budget"))
            .groupBy("key").agg(F.min_by(F.struct("bucket", (F.col("before") + F.col("upto") - F.col("inside_next")).alias("before"), "inside_next", "budget"), "bucket").alias("s"))
        )
        state = settle(crossing.select("key", "s.budget", F.col("s.bucket").alias("prefix"), "s.before", F.col("s.inside_next").alias("inside")))
        done += LEVEL_BITS
    nearer = F.col("before") + F.col("inside") - F.col("budget") < F.col("budget") - F.col("before")
    return state.select("key", F.col("prefix").alias("edge"), nearer.alias("whole"))


def mix_sources(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """How often the mix takes each document: one row per row of ``docs``.

    Columns: row (the whole input row as a struct, so that no name can clash), source
    size and target of its source, size in words, copies, taken (copies times size).
    A source whose target is above its size is taken once as a whole and the rest of the
    target is filled by a second choice.  Documents are chosen by a seeded hash of the
    document id, so reruns agree and no sort is needed.  The taken words of a source
    differ from its target by at most the rows that share the hash at the edge: one
    document, or the rows that repeat its id, which stay or go together.  Empty and NULL
    texts have size 0; NULL is a source of its own, NULL ids share one hash.
    """
    rows = docs.select(
        F.struct("*").alias("row"),
        null_safe_key(F.col(source)).alias("key"),
        F.col(source).cast("string").alias("source"),
        hash60(seed, F.col(doc_id)).alias("h"),
        n_words(F.col(text)).alias("size"),
    )
    narrow = settle(rows.select("key", "source", "h", "size"))
    sizes, n_sources = settle_counted(narrow.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")))
    targets = settle(source_targets(sizes, weights, share, cap))
    plan = targets.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
    plan = plan.withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    edges = boundary(narrow.select("key", "h", "size"), plan.select("key", "budget"), n_sources)
    plan = settle(plan.join(edges, "key", "left"))
    joined = lookup_join(rows.drop("source"), plan.select("key", "source_size", "target", F.col("copies").alias("base"), "edge", "whole"), ["key"], "left", n_sources)
    more = (F.col("h") < F.col("edge")) | ((F.col("h") == F.col("edge")) & F.col("whole"))
    # no edge: the budget is never passed, so it holds all rows (it does only when it is not below the source)
    copies = F.col("base") + F.when(F.col("edge").isNull(), F.lit(0)).otherwise(more.cast("int"))
    return joined.select("row", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


#: the mix of the registered query in SQL; sums of integers, so engines agree
MIX_SQL = r"""
WITH n AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce('=' || doc_id::VARCHAR, '~')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM n GROUP BY source),
r AS (SELECT *, (ARRAY[3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT]::DOUBLE AS w,
        source_size * 2.0::DOUBLE AS top, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(top) OVER (ORDER BY top / w, coalesce('=' || source, '~') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY top / w, coalesce('=' || source, '~') ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, coalesce(least(top, (SELECT arg_min(level, top / w) FROM l WHERE level * w < top) * w), top) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS base FROM t),
c AS (SELECT source, h, sum(size) AS inside FROM n GROUP BY source, h),
o AS (SELECT source, h, inside, sum(inside) OVER (PARTITION BY source ORDER BY h) AS upto FROM c),
e AS (SELECT p.source, min_by(o.h, o.h) AS edge, min_by(2 * o.upto - o.inside < 2 * (p.target - p.base * p.source_size), o.h) AS whole
      FROM p JOIN o ON p.source IS NOT DISTINCT FROM o.source
      WHERE o.upto > p.target - p.base * p.source_size GROUP BY p.source)
SELECT n.doc_id, n.size, p.source_size, round(p.target, 3) AS target,
       (n.size * (p.base + CASE WHEN e.edge IS NULL THEN 0 WHEN n.h < e.edge OR (n.h = e.edge AND e.whole) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM n JOIN p ON n.source IS NOT DISTINCT FROM p.source LEFT JOIN e ON n.source IS NOT DISTINCT FROM e.source
"""
