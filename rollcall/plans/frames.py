"""Queries on arrays and frame sequences; embeddings serve as 8 frames of 8 values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions import arrays as A
from rollcall.functions.hashing import hash_uniform
from rollcall.operators import frames as O
from rollcall.plans.registry import query
from rollcall.plans.tables import h01, load

WIDTH = 8


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "embeddings").select("vec_id", "label", A.to_doubles(F.col("embedding")).alias("v"))


def framed(spark: SparkSession, sf: str) -> DataFrame:
    """Frames with small values missing."""
    holes = F.transform(F.col("v"), lambda x: F.when(F.abs(x) >= 0.005, x))
    return vectors(spark, sf).select("vec_id", "label", "v", A.frames_of(holes, WIDTH).alias("frames"))


_LONG = """long AS (SELECT vec_id, label, ((i - 1) // 8)::INT AS frame, ((i - 1) % 8)::INT AS dim, CASE WHEN abs(x) >= 0.005 THEN x END AS x, x AS raw
  FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings))"""


@query(
    "scl_array_spacing",
    """WITH f AS (SELECT vec_id, list_filter(CASE WHEN vec_id % 7 = 0 THEN [700.0::DOUBLE] ELSE
         [100 + embedding[1]::DOUBLE * 2000.0, 900 + embedding[2]::DOUBLE * 2000, 1900 + embedding[3]::DOUBLE * 2000, 2900 + embedding[4]::DOUBLE * 2000] END,
         lambda x: x > 50) AS k FROM embeddings),
       d AS (SELECT vec_id, CASE WHEN len(k) >= 2 AND (list_last(k) - k[1]) / (len(k) - 1) > 100 THEN (list_last(k) - k[1]) / (len(k) - 1) END AS s FROM f),
       l AS (SELECT vec_id, s, least(greatest(35000.0::DOUBLE / (2 * s), 10), 22) AS len FROM d)
       SELECT vec_id, CASE WHEN s IS NULL THEN 15.5::DOUBLE ELSE round(len, 4) END AS length, round(coalesce(s, 1129.0::DOUBLE), 4) AS spacing,
         CASE WHEN s IS NULL THEN 103.85::DOUBLE ELSE round(len * 6.7::DOUBLE, 4) END AS estimate FROM l""",
)
def spacing(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda i: F.element_at("v", i) * 2000.0
    four = F.array(at(1) + 100.0, at(2) + 900.0, at(3) + 1900.0, at(4) + 2900.0)
    values = F.when(F.col("vec_id") % 7 == 0, F.array(F.lit(700.0))).otherwise(four)
    out = vectors(spark, sf).select("vec_id", A.spacing_summary(values).alias("s"))
    return out.select("vec_id", *[F.round(f"s.{c}", 4).alias(c) for c in ("length", "spacing", "estimate")])


@query(
    "scl_robust_inverse",
    f"""WITH {_LONG}, inv AS (SELECT vec_id, raw * 10000 AS x, CASE WHEN raw > 0 THEN 34000.0::DOUBLE / (2 * least(greatest(raw * 10000, 34000.0::DOUBLE / 70), 1700.0)) ELSE 0 END AS y FROM long)
       SELECT vec_id, round(coalesce(quantile_cont(y, 0.5) FILTER (WHERE y > 0), 0), 4) AS med,
         round(avg((x <= 0 OR x < 34000.0::DOUBLE / 70 OR x > 1700)::INT), 6) AS bad_in, round(avg((y <= 0)::INT), 6) AS bad_out FROM inv GROUP BY vec_id""",
)
def inverse(spark: SparkSession, sf: str) -> DataFrame:
    gaps = F.transform(F.col("v"), lambda x: x * 10000.0)
    lo, hi = A.spacing_bounds(34000.0, 10.0, 35.0)
    out = vectors(spark, sf).select("vec_id", gaps.alias("x")).withColumn(
        "y", F.transform("x", lambda x: A.robust_inverse(x))
    )
    positive = F.filter("y", lambda x: x > 0)
    return out.select(
        "vec_id",
        F.round(F.coalesce(A.array_median(positive), F.lit(0.0)), 4).alias("med"),
        F.round(A.share(F.col("x"), lambda x: (x <= 0) | (x < lo) | (x > hi)), 6).alias("bad_in"),
        F.round(A.share(F.col("y"), lambda x: x <= 0), 6).alias("bad_out"),
    )


@query(
    "scl_array_repair",
    f"""WITH {_LONG}, w AS (SELECT vec_id, frame, max(raw * 10000) FILTER (WHERE dim = 4) AS gap, max(raw * 10000) FILTER (WHERE dim = 5) AS old FROM long GROUP BY vec_id, frame),
       n AS (SELECT *, CASE WHEN gap > 0 THEN 34000.0::DOUBLE / (2 * least(greatest(gap, 34000.0::DOUBLE / 70), 1700.0)) ELSE 0 END AS new FROM w)
       SELECT vec_id, round(avg(old) FILTER (WHERE old > 0), 4) AS old_mean, round(max(old) FILTER (WHERE old > 0), 4) AS old_max,
         round(avg(new) FILTER (WHERE new > 0), 4) AS new_mean, round(max(new) FILTER (WHERE new > 0), 4) AS new_max,
         round(coalesce(quantile_cont(new, 0.5) FILTER (WHERE new > 0), 0), 4) AS value_median,
         round(avg((gap <= 0 OR gap < 34000.0::DOUBLE / 70 OR gap > 1700)::INT), 6) AS invalid_source_rate,
         round(avg((new <= 0)::INT), 6) AS invalid_target_rate, 'robust_v1' AS repair_tag, round(sum(new), 4) AS rewritten FROM n GROUP BY vec_id""",
)
def repair(spark: SparkSession, sf: str) -> DataFrame:
    scaled = A.frames_of(F.transform(F.col("v"), lambda x: x * 10000.0), WIDTH)
    fixed = O.repair_frames(vectors(spark, sf).select("vec_id", scaled.alias("frames")), "frames", 4, 5, "robust_v1")
    return fixed.select(
        "vec_id",
        *[F.round(c, 4).alias(c) for c in ("old_mean", "old_max", "new_mean", "new_max", "value_median")],
        *[F.round(c, 6).alias(c) for c in ("invalid_source_rate", "invalid_target_rate")],
        "repair_tag",
        F.round(A.array_sum(A.column_of(F.col("frames"), 5)), 4).alias("rewritten"),
    )


@query(
    "scl_array_crop",
    f"""WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS v, floor({h01('crop', 'vec_id')} * 45)::INT AS r FROM embeddings)
       SELECT vec_id, r AS random_start, round(list_sum(v[1:20]), 6) AS head, round(list_sum(v[23:42]), 6) AS center, round(list_sum(v[r + 1:r + 20]), 6) AS random FROM s""",
)
def crops(spark: SparkSession, sf: str) -> DataFrame:
    u = hash_uniform("crop", F.col("vec_id").cast("string"))
    total = lambda mode: F.round(A.array_sum(A.crop(F.col("v"), 20, mode, u)), 6)
    return vectors(spark, sf).select(
        "vec_id", F.floor(u * 45).cast("int").alias("random_start"), *[total(m).alias(m) for m in ("head", "center", "random")]
    )


@query(
    "scl_multi_crop",
    """WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, (64 - vec_id % 47)::INT AS size FROM embeddings),
       c AS (SELECT vec_id, v[1:size] AS v, unnest(CASE WHEN size <= 20 THEN [0] ELSE list_distinct(list_transform(range(0, 4), lambda i: round_even((size - 20) * i / 3.0::DOUBLE, 0)::INT)) END) AS start FROM n)
       SELECT vec_id, start, round(list_sum(v[start + 1:start + 20]), 6) AS total FROM c""",
)
def multi(spark: SparkSession, sf: str) -> DataFrame:
    size = (F.lit(64) - F.col("vec_id") % 47).cast("int")
    rows = vectors(spark, sf).select("vec_id", F.slice("v", F.lit(1), size).alias("v"))
    rows = rows.withColumn("start", F.explode(A.crop_starts(F.size("v"), 20, 4)))
    return rows.select(
        "vec_id", "start", F.round(A.array_sum(F.slice("v", F.col("start") + 1, F.lit(20))), 6).alias("total")
    )


@query(
    "scl_frame_stats",
    f"""WITH {_LONG} SELECT vec_id, dim, 8::BIGINT AS n_frames, round(count(x) / 8.0::DOUBLE, 6) AS finite_ratio, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std,
         round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.25), 6) AS p25,
         round(quantile_cont(x, 0.75), 6) AS p75, round(quantile_cont(x, 0.9), 6) AS p90,
         round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr, round(min(x), 6) AS min, round(max(x), 6) AS max
       FROM long GROUP BY vec_id, dim""",
)
def stats(spark: SparkSession, sf: str) -> DataFrame:
    out = O.frame_stats(framed(spark, sf), "vec_id", "frames", WIDTH)
    keep = ("vec_id", "dim", "n_frames")
    return out.select(*keep, *[F.round(c, 6).alias(c) for c in out.columns if c not in keep])


@query(
    "scl_view_algebra",
    """WITH p AS (SELECT vec_id, label, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b FROM embeddings),
       r AS (SELECT vec_id, label, unnest(a) AS a, unnest(b) AS b FROM p)
       SELECT vec_id, 97::BIGINT AS fused_width, round(sum((a + b) / 2), 6) AS mean_sum, round(sum(a - b), 6) AS delta_sum,
         round(sqrt(sum(a * a) + sum(b * b) + sum((a - b) * (a - b)) + max(label) * max(label)), 6) AS fused_norm FROM r GROUP BY vec_id""",
)
def views(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.slice("v", 1, 32), F.slice("v", 33, 32)
    delta = A.vector_delta(a, b)
    fused = F.concat(a, b, delta, F.array(F.col("label").cast("double")))
    return vectors(spark, sf).select(
        "vec_id",
        F.size(fused).cast("long").alias("fused_width"),
        F.round(A.array_sum(A.vector_mean(a, b)), 6).alias("mean_sum"),
        F.round(A.array_sum(delta), 6).alias("delta_sum"),
        F.round(A.vector_norm(fused), 6).alias("fused_norm"),
    )


@query(
    "scl_random_projection",
    f"""WITH {_LONG}, m AS (SELECT r.range::INT AS i, c.range::INT AS j, sqrt(-2.0::DOUBLE * ln(greatest({h01('13a', 'r.range', 'c.range')}, pow(2.0::DOUBLE, -53)))) * cos(2 * pi() * {h01('13b', 'r.range', 'c.range')}) / sqrt(8.0::DOUBLE) AS w FROM range(64) r, range(8) c),
       p AS (SELECT vec_id, j, sum(raw * w) AS x FROM long JOIN m ON m.i = frame * 8 + dim GROUP BY 1, 2)
       SELECT vec_id, j AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS value FROM p""",
)
def projection(spark: SparkSession, sf: str) -> DataFrame:
    out = O.random_projection(vectors(spark, sf), "vec_id", "v", 64, 8, seed=13)
    return out.select("vec_id", F.posexplode("projected").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query(
    "scl_masked_mean_pool",
    f"""WITH {_LONG} SELECT vec_id, dim, round(coalesce(avg(raw) FILTER (WHERE (vec_id + frame) % 3 <> 0 AND vec_id % 10 <> 0), 0), 6) AS pooled FROM long GROUP BY vec_id, dim""",
)
def masked(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("vec_id")
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: ((key + i) % 3 != 0) & (key % 10 != 0))
    rows = vectors(spark, sf).select("vec_id", A.frames_of(F.col("v"), WIDTH).alias("frames"), mask.alias("mask"))
    pooled = A.masked_mean(F.col("frames"), F.col("mask"), WIDTH)
    return rows.select("vec_id", F.posexplode(pooled).alias("dim", "pooled")).withColumn("pooled", F.round("pooled", 6))


@query(
    "scl_broadcast_concat",
    """SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 8 ELSE 10 END::BIGINT AS width,
         round(list_sum(embedding::DOUBLE[]) + CASE WHEN vec_id % 4 = 0 THEN 0 ELSE 8.0::DOUBLE * (label + 1) END, 6) AS total,
         CASE WHEN vec_id % 4 = 0 THEN 'missing' ELSE 'label_v1' END AS tag FROM embeddings""",
)
def appended(spark: SparkSession, sf: str) -> DataFrame:
    extra = F.when(F.col("vec_id") % 4 != 0, F.array(F.col("label").cast("double"), F.lit(1.0)))
    rows = vectors(spark, sf).select("vec_id", A.frames_of(F.col("v"), WIDTH).alias("frames"), extra.alias("extra"))
    fused = A.append_to_frames(F.col("frames"), F.col("extra"))
    return rows.select(
        "vec_id",
        F.size(F.get(fused, F.lit(0))).cast("long").alias("width"),
        F.round(A.array_sum(F.flatten(fused)), 6).alias("total"),
        F.when(F.col("extra").isNull(), "missing").otherwise("label_v1").alias("tag"),
    )
