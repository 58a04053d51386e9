"""Queries for summaries, distributions, drift and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions import numbers as N
from rollcall.functions.arrays import to_doubles
from rollcall.functions.quality import item_outcome, item_weight
from rollcall.operators import profile as P
from rollcall.operators import vectors as V
from rollcall.operators.grouped import lookup_join, scalar
from rollcall.plans.frames import vectors
from rollcall.plans.registry import query
from rollcall.plans.rules import measured
from rollcall.plans.tables import entities, items, load, with_sql

PAIRS = (("train", "val"), ("train", "test"))


def rounded(df: DataFrame, digits: int = 8, keep: tuple = ()) -> DataFrame:
    """Doubles rounded, other columns unchanged."""
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes]
    )


@query(
    "agg_split_summary",
    with_sql("ent")
    + """, l AS (SELECT split, entity_id, unnest([{'dim': 'all', 'val': 'all'}, {'dim': 'source', 'val': source}, {'dim': 'segment', 'val': segment},
         {'dim': 'bin', 'val': CASE WHEN y < 160 THEN 'short' WHEN y < 175 THEN 'medium' ELSE 'tall' END}]) AS p FROM ent)
       SELECT split, p.dim AS dim, p.val AS val, count(*) AS n_rows, count(DISTINCT entity_id) AS n_unique FROM l GROUP BY 1, 2, 3""",
)
def split_summary(spark: SparkSession, sf: str) -> DataFrame:
    dims = {"source": F.col("source"), "segment": F.col("segment"), "bin": N.target_bin(F.col("y"))}
    return P.split_summary(entities(spark, sf), "split", "entity_id", dims)


_LONG = "long AS (SELECT * FROM (SELECT source, unnest([{'metric': 'y', 'value': y}, {'metric': 'age', 'value': age}, {'metric': 'weight', 'value': weight}], recursive := true) FROM ent) WHERE value IS NOT NULL)"


@query(
    "agg_describe",
    with_sql("ent", more=_LONG)
    + """, b AS (SELECT source, metric, count(*) AS n, min(value) AS min, max(value) AS max, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std,
           quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75 FROM long GROUP BY 1, 2),
       k AS (SELECT source, metric, coalesce(avg(pow((value - mean) / nullif(std, 0), 3)), 0) AS skew FROM long JOIN b USING (source, metric) GROUP BY 1, 2)
       SELECT source, metric, n, round(min, 8) AS min, round(max, 8) AS max, round(mean, 8) AS mean, round(std, 8) AS std, round(median, 8) AS median,
         round(p25, 8) AS p25, round(p75, 8) AS p75, round(skew, 8) AS skew,
         CASE WHEN skew > 0.5 THEN 'right' WHEN skew < -0.5 THEN 'left' ELSE 'symmetric' END AS skew_label FROM b JOIN k USING (source, metric)""",
)
def describe(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.describe(entities(spark, sf), ("y", "age", "weight"), ("source",)))


@query(
    "agg_histogram",
    """WITH l AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
       c AS (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19)::INT AS bin, count(*) AS n FROM lineitem, l GROUP BY 1),
       f AS (SELECT b.range::INT AS bin, coalesce(n, 0) AS n FROM range(20) b LEFT JOIN c ON c.bin = b.range)
       SELECT bin, round(lo + bin * ((hi - lo) / 20), 8) AS lo, round(lo + (bin + 1) * ((hi - lo) / 20), 8) AS hi, n,
         floor(n / (SELECT max(n) FROM f) * 48)::BIGINT AS bar FROM f, l""",
)
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.histogram(load(spark, sf, "lineitem"), "l_extendedprice", 20))


@query(
    "agg_imbalance",
    """WITH c AS (SELECT source, lang, count(*) AS c FROM documents GROUP BY 1, 2)
       SELECT source, count(*) AS n_classes, round(CASE WHEN count(*) <= 1 THEN 1.0 ELSE greatest(0.0, 1.0 - (ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(count(*))) END, 8) AS imbalance
       FROM c GROUP BY source""",
)
def imbalance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.imbalance(load(spark, sf, "documents"), "lang", ("source",)))


@query(
    "agg_pearson",
    """WITH l AS (SELECT l_returnflag, unnest([{'pair': 'l_quantity~l_extendedprice', 'a': l_quantity, 'b': l_extendedprice},
         {'pair': 'l_discount~l_tax', 'a': CASE WHEN l_linenumber <> 3 THEN l_discount END, 'b': l_tax}], recursive := true) FROM lineitem)
       SELECT l_returnflag, pair, count(*) AS n, round(corr(a, b), 8) AS r FROM l WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2""",
)
def pearson(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").withColumn("l_discount", F.when(F.col("l_linenumber") != 3, F.col("l_discount")))
    return rounded(P.pearson(rows, [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")], ("l_returnflag",)))


KS_SQL = """c AS (SELECT metric, value, count(*) FILTER (WHERE split = 'train') AS a, count(*) FILTER (WHERE split = 'val') AS b, count(*) FILTER (WHERE split = 'test') AS t FROM klong GROUP BY 1, 2),
  r AS (SELECT metric, sum(a) OVER w / sum(a) OVER p AS fa, sum(b) OVER w / sum(b) OVER p AS fb, sum(t) OVER w / sum(t) OVER p AS ft FROM c
        WINDOW w AS (PARTITION BY metric ORDER BY value ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY metric)),
  ksd AS (SELECT metric, 'train_val' AS pair, max(abs(fa - fb)) AS d FROM r GROUP BY 1 UNION ALL SELECT metric, 'train_test', max(abs(fa - ft)) FROM r GROUP BY 1)"""
KLONG = "klong AS (SELECT * FROM (SELECT split, unnest([{'metric': 'y', 'value': y}, {'metric': 'age', 'value': age}, {'metric': 'weight', 'value': weight}], recursive := true) FROM ent) WHERE value IS NOT NULL)"


@query("agg_ks", with_sql("ent", more=f"{KLONG}, {KS_SQL}") + "SELECT metric, pair, round(d, 6) AS d FROM ksd")
def ks(spark: SparkSession, sf: str) -> DataFrame:
    long = P.unpivot(entities(spark, sf), ("split",), ("y", "age", "weight"))
    return rounded(P.ks(long, ("metric",), "value", "split", PAIRS), 6)


@query(
    "agg_item_counts",
    with_sql("ent", "items")
    + """, n AS (SELECT source, entity_id, count(*) AS n FROM items JOIN ent USING (entity_id) GROUP BY 1, 2)
       SELECT source, count(*) AS n_entities, min(n) AS min_items, max(n) AS max_items, round(avg(n), 8) AS mean_items FROM n GROUP BY ROLLUP (source)""",
)
def item_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = lookup_join(items(spark, sf).select("entity_id"), entities(spark, sf).select("entity_id", "source"), ["entity_id"], "inner")
    return rounded(P.item_counts(rows, "entity_id", "source"))


_READY = f"""n AS (SELECT count(*)::DOUBLE AS n FROM ent),
  gi AS (SELECT 1.0 - (ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(count(*)) AS v FROM (SELECT g, count(*) AS c FROM ent GROUP BY 1)),
  si AS (SELECT 1.0 - (ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(count(*)) AS v FROM (SELECT source, count(*) AS c FROM ent GROUP BY 1)),
  mk AS (SELECT avg(d) AS v FROM ksd),
  ri AS (SELECT avg(k) AS v FROM (SELECT entity_id, count(*) * CASE WHEN any_value(source) = 'ASIA' AND any_value(split) = 'train' THEN 2 ELSE 1 END AS k FROM items JOIN ent USING (entity_id) GROUP BY 1)),
  zs AS (SELECT metric, avg(value) AS m, stddev_samp(value) AS s FROM klong GROUP BY 1),
  zo AS (SELECT count(*)::DOUBLE AS v FROM klong JOIN zs USING (metric) WHERE abs((value - m) / s) > 1.7),
  sc AS (SELECT least(n / 800, 1.0) AS size, least(1.0, 1.1 - gi.v) AS group_balance, least(1.0, 1.1 - si.v) AS source_balance, greatest(0.0, 1.0 - 0.35 * mk.v) AS split_consistency,
    least(ri.v / 35, 1.0) AS richness, greatest(0.0, 1.0 - zo.v / (n * 3)) AS cleanliness FROM n, gi, si, mk, ri, zo)"""


@query(
    "agg_readiness",
    with_sql("ent", "items", more=f"{KLONG}, {KS_SQL}, {_READY}")
    + """SELECT round(size, 8) AS size, round(group_balance, 8) AS group_balance, round(source_balance, 8) AS source_balance, round(split_consistency, 8) AS split_consistency,
         round(richness, 8) AS richness, round(cleanliness, 8) AS cleanliness,
         round(CASE WHEN o >= 95 THEN 100 ELSE o END, 8) AS overall FROM (SELECT *, (size + group_balance + source_balance + split_consistency + richness + cleanliness) / 6 * 100 AS o FROM sc)""",
)
def readiness(spark: SparkSession, sf: str) -> DataFrame:
    ent = entities(spark, sf)
    long = P.unpivot(ent, ("split",), ("y", "age", "weight"))
    mean_ks = P.ks(long, ("metric",), "value", "split", PAIRS).agg(F.avg("d").alias("v"))
    double = F.when((F.col("source") == "ASIA") & (F.col("split") == "train"), 2).otherwise(1)
    per = items(spark, sf).groupBy("entity_id").agg(F.count(F.lit(1)).alias("k")).join(ent.select("entity_id", "source", "split"), "entity_id")
    rich = per.agg(F.avg(F.col("k") * double).alias("v"))
    stats = ent.agg(*[f(c).alias(f"{n}_{c}") for c in ("y", "age", "weight") for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    z = stats.select(F.struct(*stats.columns)).scalar()
    far = [F.count_if(F.abs((F.col(c) - F.col(f"_z.m_{c}")) / F.col(f"_z.s_{c}")) > 1.7) for c in ("y", "age", "weight")]
    outliers = ent.withColumn("_z", z).agg((far[0] + far[1] + far[2]).cast("double").alias("v"))
    one = ent.agg(F.count(F.lit(1)).cast("double").alias("n"))
    scores = P.readiness(
        F.col("n"), scalar(P.imbalance(ent, "g"), "imbalance"), scalar(P.imbalance(ent, "source"), "imbalance"),
        scalar(mean_ks, "v"), scalar(rich, "v"), scalar(outliers, "v"),
    )
    return rounded(one.select(*[c.alias(n) for n, c in scores.items()]))


@query(
    "agg_target_stats",
    with_sql("ent")
    + """SELECT target, count(v) AS n, round(coalesce(avg(v), 0), 8) AS mean, round(coalesce(stddev_pop(v) + 1e-9, 1), 8) AS std FROM (
         SELECT unnest([{'target': 'height', 'v': y}, {'target': 'age', 'v': age}, {'target': 'weight', 'v': CASE WHEN source = 'ASIA' THEN weight END}], recursive := true)
         FROM ent WHERE split = 'train') GROUP BY target""",
)
def target_stats(spark: SparkSession, sf: str) -> DataFrame:
    targets = {"height": F.col("y"), "age": F.col("age"), "weight": F.when(F.col("source") == "ASIA", F.col("weight"))}
    return rounded(P.target_stats(entities(spark, sf), targets, F.col("split") == "train"))


SCALARS = ("duration", "speech", "snr", "quality", "voiced", "drift")


def split_items(spark: SparkSession, sf: str) -> DataFrame:
    return lookup_join(items(spark, sf), entities(spark, sf).select("entity_id", "split"), ["entity_id"], "inner")


_CHECKS = {
    "missing_drift": "drift IS NULL", "zero_voiced": "voiced IS NULL OR voiced <= 0", "negative_snr": "snr <= 0",
    "no_duration": "duration <= 0", "all_zero": "voiced <= 0 AND duration <= 0", "rejected": "quality < 0.2",
    "infinite_drift": "abs(drift) = 'inf'", "nan_or_missing_drift": "drift IS NULL", "clipped_any": "clipped > 0", "far": "distance > 45",
}


@query(
    "agg_feature_diagnostics",
    with_sql("ent", "items")
    + "SELECT split, count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities, "
    + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in _CHECKS.items())
    + ", ".join(["", *[f"round(avg({s}), 8) AS mean_{s}, round(stddev_pop({s}), 8) AS std_{s}, round(min({s}), 8) AS min_{s}, round(max({s}), 8) AS max_{s}" for s in SCALARS]])
    + " FROM items JOIN ent USING (entity_id) GROUP BY split",
)
def diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    rows = split_items(spark, sf)
    counts = P.validity_counts(rows, ("split",), "entity_id", {n: F.expr(c.replace("'inf'", "double('inf')")) for n, c in _CHECKS.items()})
    summary = P.scalar_summary(rows, SCALARS, ("split",))
    wide = summary.groupBy("split").agg(
        *[F.max(F.when(F.col("feature") == s, F.col(c))).alias(f"{c}_{s}") for s in SCALARS for c in ("mean", "std", "min", "max")]
    )
    return rounded(counts.join(wide, "split"))


@query(
    "agg_zero_variance",
    "SELECT d.range::INT AS dim FROM range(64) d WHERE (d.range + 1) % 10 = 0",
)
def zero_variance(spark: SparkSession, sf: str) -> DataFrame:
    flat = F.transform("v", lambda x, i: F.when((i + 1) % 10 == 0, F.lit(0.25)).otherwise(x))
    return P.zero_variance(vectors(spark, sf).select(flat.alias("v")), "v")


_SUMMARY = "summ AS (SELECT split, feature, avg(v) AS mean, stddev_pop(v) AS std FROM (SELECT split, unnest([" + ", ".join(
    f"{{'feature': '{s}', 'v': {s}}}" for s in SCALARS
) + "], recursive := true) FROM items JOIN ent USING (entity_id)) WHERE v IS NOT NULL GROUP BY 1, 2)"


@query(
    "agg_drift",
    with_sql("ent", "items", more=_SUMMARY)
    + """SELECT o.split, o.feature, round(r.mean, 8) AS reference_mean, round(o.mean, 8) AS other_mean, round(abs(o.mean - r.mean), 8) AS abs_shift,
         round(abs(o.mean - r.mean) / CASE WHEN abs(r.std) > 1e-9 THEN abs(r.std) ELSE 1 END, 8) AS std_units
       FROM summ o JOIN summ r ON o.feature = r.feature AND r.split = 'train' AND o.split <> 'train'""",
)
def drift(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.drift(P.scalar_summary(split_items(spark, sf), SCALARS, ("split",)), "split"))


_IWSQL = "least(greatest(least(greatest(speech, 0.1), 1.25) * least(greatest(1.0::DOUBLE - clipped * 4.0, 0.2), 1.0), 0.05), 1.5)"


@query(
    "agg_entity_scalars",
    with_sql("items")
    + f""", w AS (SELECT *, {_IWSQL} AS w FROM items),
       l AS (SELECT * FROM (SELECT entity_id, w, unnest([{{'feature': 'pred', 'v': pred}}, {{'feature': 'drift', 'v': drift}}, {{'feature': 'snr', 'v': snr}}], recursive := true) FROM w) WHERE v IS NOT NULL),
       n AS (SELECT entity_id, count(*) AS n_items, avg(w) AS w_mean, stddev_pop(w) AS w_std, min(w) AS w_min, max(w) AS w_max FROM w GROUP BY 1)
       SELECT entity_id, feature, round(sum(w * v) / sum(w), 8) AS mean, round(stddev_pop(v), 8) AS std, round(quantile_cont(v, 0.5), 8) AS median,
         round(quantile_cont(v, 0.1), 8) AS p10, round(quantile_cont(v, 0.9), 8) AS p90, any_value(n_items) AS n_items, round(any_value(w_mean), 8) AS w_mean,
         round(any_value(w_std), 8) AS w_std, round(any_value(w_min), 8) AS w_min, round(any_value(w_max), 8) AS w_max
       FROM l JOIN n USING (entity_id) GROUP BY entity_id, feature""",
)
def entity_scalars(spark: SparkSession, sf: str) -> DataFrame:
    weight = item_weight(F.col("speech"), F.lit(None).cast("double"), F.col("clipped"))
    rows = items(spark, sf).withColumn("w", weight)
    features = P.entity_features(rows, "entity_id", ("pred", "drift", "snr"), "w")
    return rounded(features.join(P.entity_weights(rows, "entity_id", "w"), "entity_id"), 8)


_VECTOR_ITEMS = f"""it AS (SELECT label * 1000000::BIGINT + vec_id // 40 AS entity_id, embedding, (vec_id % 97) / 96.0::DOUBLE AS speech, (vec_id % 13) / 100.0::DOUBLE AS clipped FROM embeddings),
  wt AS (SELECT entity_id, embedding, {_IWSQL} AS w FROM it),
  l AS (SELECT entity_id, w, (generate_subscripts(embedding, 1) - 1)::INT AS dim, unnest(embedding)::DOUBLE AS raw FROM wt),
  v AS (SELECT entity_id, dim, w, CASE WHEN abs(raw) >= 0.002 THEN raw END AS x FROM l)"""


@query(
    "agg_entity_features",
    f"""WITH {_VECTOR_ITEMS}
       SELECT entity_id, dim, round(sum(w * x) / sum(w) FILTER (WHERE x IS NOT NULL), 8) AS mean, round(stddev_pop(x), 8) AS std, round(quantile_cont(x, 0.5), 8) AS median,
         round(quantile_cont(x, 0.1), 8) AS p10, round(quantile_cont(x, 0.9), 8) AS p90, count(x) AS n
       FROM v GROUP BY entity_id, dim""",
)
def entity_features(spark: SparkSession, sf: str) -> DataFrame:
    """Six statistics per dimension and entity of the item vectors; values near zero count as missing."""
    rows = load(spark, sf, "embeddings").where("embedding IS NOT NULL AND label IS NOT NULL")
    weight = item_weight(F.col("vec_id") % 97 / F.lit(96.0), F.lit(None).cast("double"), F.col("vec_id") % 13 / F.lit(100.0))
    holes = F.transform(to_doubles(F.col("embedding")), lambda x: F.when(F.abs(x) >= 0.002, x))
    found = rows.select((F.col("label") * 1_000_000 + F.floor(F.col("vec_id") / 40)).cast("long").alias("entity_id"), holes.alias("v"), weight.alias("w"))
    return rounded(V.vector_statistics_long(found, "entity_id", "v", "w"), 8)


@query(
    "agg_entity_embedding",
    """WITH l AS (SELECT label, (i - 1)::INT AS dim, x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) WHERE label < 8)
       SELECT label, dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(ln(1.0 + count(*)), 6) AS log_n FROM l GROUP BY 1, 2""",
)
def entity_embedding(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    wanted = rows.filter("label < 8").select("label")
    return rounded(P.entity_embedding(rows, "label", "v", wanted), 6)


@query(
    "agg_run_stats",
    with_sql("ent", "items")
    + """SELECT source, count(*) AS processed, count(*) FILTER (WHERE duration < 1.5) AS dropped, count(*) FILTER (WHERE duration > 10) AS truncated,
         count(*) FILTER (WHERE duration < 1) AS flagged, round(avg(duration), 8) AS mean_before, round(avg(least(duration, 10)) FILTER (WHERE duration >= 1.5), 8) AS mean_final
       FROM items JOIN ent USING (entity_id) GROUP BY ROLLUP (source)""",
)
def run_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = items(spark, sf).withColumns(item_outcome(F.col("duration")))
    return rounded(P.run_stats(lookup_join(rows, entities(spark, sf).select("entity_id", "source"), ["entity_id"], "inner"), "source"))


@query(
    "agg_probe_audit",
    with_sql("items")
    + """, s AS (SELECT entity_id FROM (SELECT DISTINCT entity_id FROM items) ORDER BY md5(concat('42:', entity_id)), entity_id LIMIT 200),
       p AS (SELECT item_id, item_id % 6 <> 0 AS found, (item_id % 5 * 4000)::INT AS rate, (item_id % 4)::INT AS channels, CASE WHEN item_id % 53 <> 0 THEN (item_id % 35)::DOUBLE END AS duration, (item_id % 50) / 1000.0::DOUBLE AS peak
             FROM items SEMI JOIN s USING (entity_id))
       SELECT count(*) AS n_items, count(*) FILTER (WHERE NOT found) AS n_missing, count(DISTINCT rate) FILTER (WHERE found) AS n_rates, max(rate) FILTER (WHERE found) AS max_rate,
         max(channels) FILTER (WHERE found) AS max_channels, min(duration) FILTER (WHERE found) AS min_duration, max(duration) FILTER (WHERE found) AS max_duration,
         round(avg(duration) FILTER (WHERE found), 8) AS mean_duration, min(peak) FILTER (WHERE found) AS min_peak, max(peak) FILTER (WHERE found) AS max_peak, round(avg(peak) FILTER (WHERE found), 8) AS mean_peak,
         TRUE AS resample, TRUE AS downmix, TRUE AS drop_short, TRUE AS normalise FROM p""",
)
def probe(spark: SparkSession, sf: str) -> DataFrame:
    listing = measured(spark, sf).filter("item_id % 6 <> 0").select("item_id", "rate", "channels", "duration", "peak")
    return rounded(P.probe_audit(items(spark, sf), "entity_id", "item_id", listing, 200))


@query(
    "agg_csv_stats",
    """WITH refs AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 45 = 0 THEN ['doc/none'] ELSE
         [concat('doc/', c_custkey * 2 % m), concat('doc/', c_custkey * 14 % m), concat('doc/', c_custkey * 2 % m), concat('doc/', c_custkey * 6 % m)] END AS l FROM customer, (SELECT count(*) * 13 // 10 AS m FROM documents)),
       have AS (SELECT list(concat('doc/', doc_id)) AS h FROM documents WHERE doc_id % 5 <> 0),
       k AS (SELECT id % 3 AS part, len(l) AS raw, len(list_distinct(l)) AS uniq, len(list_filter(list_distinct(l), lambda x: list_contains(h, x))) AS kept FROM refs, have)
       SELECT part, count(*) AS rows_before, count(*) FILTER (WHERE kept > 0) AS rows_after, count(*) FILTER (WHERE kept = 0) AS rows_removed,
         sum(uniq - kept)::BIGINT AS paths_removed, sum(raw - uniq)::BIGINT AS paths_deduped FROM k GROUP BY part""",
)
def csv_stats(spark: SparkSession, sf: str) -> DataFrame:
    from rollcall.operators.audit import resolve_refs
    from rollcall.plans.audit import listing, references

    kept, _ = resolve_refs(references(spark, sf), "entity_id", "paths", listing(spark, sf), "path")
    empty = F.size("paths") == 0
    return kept.groupBy((F.col("entity_id") % 3).alias("part")).agg(
        F.count(F.lit(1)).alias("rows_before"), F.count_if(~empty).alias("rows_after"), F.count_if(empty).alias("rows_removed"),
        F.sum("n_missing").alias("paths_removed"), F.sum("n_deduped").alias("paths_deduped"),
    )


@query(
    "agg_duplicates",
    """WITH d AS (SELECT doc_id, sha256(text) AS digest FROM documents)
       SELECT digest, doc_id, min(doc_id) OVER (PARTITION BY digest) AS same_content_as, count(*) OVER (PARTITION BY digest) AS n_copies FROM d
       QUALIFY n_copies > 1 AND doc_id <> same_content_as""",
)
def dups(spark: SparkSession, sf: str) -> DataFrame:
    from rollcall.operators.audit import duplicates

    return duplicates(load(spark, sf, "documents").select("doc_id", "text"), "doc_id", F.octet_length("text"), F.sha2("text", 256))


# Target entities per role and group.
QUOTA = {
    ("development", "all"): 120, ("sealed_test", "all"): 80,
    ("development", "Male"): 30, ("sealed_test", "Male"): 15,
}


@query(
    "agg_quota",
    with_sql("ent")
    + """, a AS (SELECT entity_id, CASE WHEN split = 'test' THEN 'sealed_test' ELSE 'development' END AS role, CASE WHEN g = 1 THEN 'Male' ELSE 'Female' END AS grp FROM ent WHERE y < 160 AND source = 'ASIA'),
       t AS (SELECT * FROM (VALUES ('development', 'all', 120), ('sealed_test', 'all', 80), ('development', 'Male', 30), ('sealed_test', 'Male', 15)) v(role, grp, target))
       SELECT t.role, t.grp, t.target::BIGINT AS target, count(DISTINCT entity_id) AS achieved, greatest(0, t.target - count(DISTINCT entity_id))::BIGINT AS remaining
       FROM t LEFT JOIN a ON a.role = t.role AND (t.grp = 'all' OR a.grp = t.grp) GROUP BY t.role, t.grp, t.target""",
)
def quota(spark: SparkSession, sf: str) -> DataFrame:
    rows = entities(spark, sf).filter("y < 160 AND source = 'ASIA'").select(
        "entity_id", F.when(F.col("split") == "test", "sealed_test").otherwise("development").alias("role"),
        F.when(F.col("g") == 1, "Male").otherwise("Female").alias("grp"),
    )
    return P.quota(rows, QUOTA)
