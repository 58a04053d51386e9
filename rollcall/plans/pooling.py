"""Queries for item-to-entity pooling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions.hashing import hash_uniform
from rollcall.functions.quality import reliability
from rollcall.operators import pooling as P
from rollcall.operators.grouped import lookup_join
from rollcall.plans.profile import rounded
from rollcall.plans.registry import query
from rollcall.plans.scalars import RELIABILITY_SQL, reliability_columns
from rollcall.plans.tables import entities, h01, items, with_sql


def rounded6(df: DataFrame) -> DataFrame:
    return rounded(df, 6)


def pooled_items(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).withColumn("rel", reliability(reliability_columns(), 200.0))


_REL = f"rel AS (SELECT *, {RELIABILITY_SQL} AS rel FROM items)"


@query(
    "agg_pool_weighted",
    with_sql("items", more=_REL)
    + "SELECT entity_id, round(sum(rel * pred) / sum(rel), 6) AS mean, round(var_pop(pred), 6) AS var, count(*) AS n FROM rel GROUP BY entity_id",
)
def weighted(spark: SparkSession, sf: str) -> DataFrame:
    return rounded6(P.pool(pooled_items(spark, sf), "mean", "entity_id", "pred", F.col("rel"), F.col("var")))


@query(
    "agg_pool_inverse_variance",
    with_sql("items", more=_REL)
    + "SELECT entity_id, round(sum(rel / var * pred) / sum(rel / var), 6) AS mean, round(1.0 / sum(rel / var), 6) AS var, count(*) AS n FROM rel GROUP BY entity_id",
)
def inverse_variance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded6(P.pool(pooled_items(spark, sf), "legacy_inverse_variance", "entity_id", "pred", F.col("rel"), F.col("var")))


@query(
    "agg_pool_attention",
    with_sql("items", more=_REL)
    + """, a AS (SELECT entity_id, pred, exp(rel / (var + 1e-6) - max(rel / (var + 1e-6)) OVER (PARTITION BY entity_id)) AS a FROM rel),
       m AS (SELECT *, sum(a * pred) OVER p / sum(a) OVER p AS mean FROM a WINDOW p AS (PARTITION BY entity_id))
       SELECT entity_id, round(any_value(mean), 6) AS mean, round(sum(a * pow(pred - mean, 2)) / sum(a), 6) AS var, count(*) AS n FROM m GROUP BY entity_id""",
)
def attention(spark: SparkSession, sf: str) -> DataFrame:
    return rounded6(P.pool(pooled_items(spark, sf), "attention", "entity_id", "pred", F.col("rel"), F.col("var")))


_ROBUST = """b AS (SELECT entity_id, pred AS v, var, greatest(greatest(rel, 1e-6) * least(greatest(1.0 / (1.0 + sqrt(var) / 3), 0.05), 1.0), 1e-6) AS w FROM rel),
  m AS (SELECT *, quantile_disc(v, 0.5) OVER (PARTITION BY entity_id) AS med FROM b),
  d AS (SELECT *, greatest(quantile_disc(abs(v - med), 0.5) OVER (PARTITION BY entity_id), 1e-4) AS mad FROM m),
  z AS (SELECT *, 0.6745 * abs(v - med) / mad <= 2.5 AS inl FROM d),
  s AS (SELECT *, inl OR count(*) FILTER (WHERE inl) OVER (PARTITION BY entity_id) < 3 AS keep, count(*) OVER (PARTITION BY entity_id) AS total FROM z),
  k AS (SELECT entity_id, v, var, total, w / sum(w) OVER p AS w, sum(w * v) OVER p / sum(w) OVER p AS c FROM s WHERE keep WINDOW p AS (PARTITION BY entity_id)),
  e AS (SELECT *, greatest(1.5, 1.25 * quantile_disc(abs(v - c), 0.5) OVER (PARTITION BY entity_id)) AS delta FROM k),
  h1 AS (SELECT *, greatest(w * least(1.0, delta / greatest(abs(v - c), 1e-6)), 1e-6) AS w1 FROM e),
  c1 AS (SELECT *, sum(w1 * v) OVER p / sum(w1) OVER p AS c1 FROM h1 WINDOW p AS (PARTITION BY entity_id)),
  h2 AS (SELECT *, greatest(w * least(1.0, delta / greatest(abs(v - c1), 1e-6)), 1e-6) AS w2 FROM c1),
  c2 AS (SELECT *, sum(w2 * v) OVER p / sum(w2) OVER p AS c2 FROM h2 WINDOW p AS (PARTITION BY entity_id))"""


@query(
    "agg_pool_robust",
    with_sql("items", more=f"{_REL}, {_ROBUST}")
    + """SELECT entity_id, round(any_value(c2), 6) AS mean, round(sum(w2 * pow(v - c2, 2)) / sum(w2) + sum(w2 * var) / sum(w2), 6) AS var,
         count(*) AS surviving, any_value(total) - count(*) AS rejected FROM c2 GROUP BY entity_id""",
)
def robust(spark: SparkSession, sf: str) -> DataFrame:
    return rounded6(P.pool(pooled_items(spark, sf), "robust", "entity_id", "pred", F.col("rel"), F.col("var")))


EVIDENCE = """tot AS (SELECT KEYS, count(*) AS n_total, count(*) FILTER (WHERE var <= 25) AS valid FROM src GROUP BY KEYS),
  m AS (SELECT *, quantile_cont(pred, 0.5) OVER (PARTITION BY KEYS) AS med FROM src WHERE var <= 25),
  d AS (SELECT *, greatest(quantile_cont(abs(pred - med), 0.5) OVER (PARTITION BY KEYS), 1e-4) AS mad FROM m),
  z AS (SELECT *, 0.6745 * (abs(pred - med) / mad) <= 1.5 AS ok FROM d),
  p AS (SELECT KEYS, count(*) FILTER (WHERE ok) AS kept, any_value(med) AS med, avg(sqrt(var)) AS std, sum(q / (var + 1e-6) * pred) FILTER (WHERE ok) / sum(q / (var + 1e-6)) FILTER (WHERE ok) AS mean,
        sqrt(1.5 / sum(1.0 / var) FILTER (WHERE ok)) AS pstd FROM z GROUP BY KEYS),
  res AS (SELECT tot.*, CASE WHEN valid < 2 THEN 0 WHEN kept < 2 THEN 1 WHEN pstd <= 2.5 THEN 2 ELSE 3 END AS s, kept, med, std, mean, pstd FROM tot LEFT JOIN p USING (KEYS))"""


@query(
    "agg_pool_evidence",
    with_sql("items", more="src AS (SELECT entity_id, pred, var, quality AS q FROM items), " + EVIDENCE.replace("KEYS", "entity_id"))
    + """SELECT entity_id, round(CASE s WHEN 0 THEN 0 WHEN 1 THEN med ELSE mean END, 6) AS mean, round(CASE s WHEN 0 THEN 0 WHEN 1 THEN std ELSE pstd END, 6) AS std,
         CASE s WHEN 0 THEN valid ELSE kept END AS n_accepted, n_total, s = 2 AS is_confident, CASE WHEN s = 2 THEN 'SUCCESS' ELSE 'ABSTAIN' END AS status,
         CASE s WHEN 0 THEN concat('Insufficient clips passed variance/quality check (', valid, '/', n_total, ')') WHEN 1 THEN 'Inconsistent evidence cluster. Median fallback used.'
           WHEN 2 THEN 'High confidence prediction' ELSE printf('Uncertainty (±%.2fcm) above target', pstd) END AS message FROM res""",
)
def evidence(spark: SparkSession, sf: str) -> DataFrame:
    return rounded6(P.pool_evidence(items(spark, sf), ["entity_id"], "pred", "var", F.col("quality")))


@query(
    "agg_group_majority",
    with_sql("items")
    + """, c AS (SELECT entity_id, label, count(*) AS votes FROM items GROUP BY 1, 2)
       SELECT entity_id, label, votes, sum(votes) OVER (PARTITION BY entity_id)::BIGINT AS n FROM c
       QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY votes DESC, label) = 1""",
)
def majority(spark: SparkSession, sf: str) -> DataFrame:
    return P.group_majority(items(spark, sf), "entity_id", "label")


@query(
    "agg_first_truth",
    with_sql("items")
    + """SELECT entity_id, round(arg_min(drift, (day, item_id)) FILTER (WHERE drift IS NOT NULL), 8) AS drift, round(avg(duration), 8) AS duration, round(avg(quality), 8) AS quality
         FROM items GROUP BY entity_id""",
)
def truth(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.first_truth(items(spark, sf), "entity_id", "drift", ("day", "item_id"), ("duration", "quality")), 8)


@query(
    "agg_class_pool",
    with_sql("items")
    + """, l AS (SELECT entity_id, unnest([{'cls': 'a', 'p': quality}, {'cls': 'b', 'p': 1.0::DOUBLE - quality}], recursive := true), 0.5::DOUBLE + voiced AS w FROM items),
       c AS (SELECT entity_id, cls, sum(p * w) / sum(w) AS p FROM l GROUP BY 1, 2)
       SELECT entity_id, cls AS predicted, round(p, 6) AS prob FROM c QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY p DESC, cls) = 1""",
)
def classes(spark: SparkSession, sf: str) -> DataFrame:
    probs = F.array(
        F.struct(F.lit("a").alias("cls"), F.col("quality").alias("p")), F.struct(F.lit("b").alias("cls"), (1.0 - F.col("quality")).alias("p"))
    )
    rows = items(spark, sf).select("entity_id", (F.lit(0.5) + F.col("voiced")).alias("w"), F.explode(probs).alias("c")).select("entity_id", "w", "c.*")
    return rounded6(P.class_pool(rows, "entity_id", "cls", "p", "w"))


@query(
    "agg_pass_summary",
    with_sql("items")
    + f""", l AS (SELECT item_id, pred + {h01('pass', 'item_id', 'k')} * 4 AS v, ln(var) + {h01('lv', 'item_id', 'k')} AS lv FROM items CROSS JOIN (VALUES (1), (2), (3), (4), (5)) p(k))
       SELECT item_id, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS epistemic, round(avg(exp(lv)), 6) AS aleatoric, count(*) AS n_passes, round(var_pop(v) + avg(exp(lv)), 6) AS total FROM l GROUP BY 1""",
)
def passes(spark: SparkSession, sf: str) -> DataFrame:
    rows = items(spark, sf).select("item_id", "pred", "var", F.explode(F.array(*[F.lit(k) for k in range(1, 6)])).alias("k"))
    u = lambda seed: hash_uniform(seed, F.col("item_id").cast("string"), F.col("k").cast("string"))
    rows = rows.withColumns({"v": F.col("pred") + u("pass") * 4, "lv": F.ln("var") + u("lv")})
    return rounded6(P.pass_summary(rows, "item_id", "v", "lv"))


@query(
    "agg_quality_rollup",
    with_sql("items")
    + """, w AS (SELECT *, ln(2.0::DOUBLE + quality) AS w, list_filter([CASE WHEN snr < 0 THEN 'low_snr' END, CASE WHEN distance > 60 THEN 'far_microphone' END], lambda x: x IS NOT NULL) AS ws FROM items),
       u AS (SELECT entity_id, array_to_string(list_sort(list(DISTINCT x)), '|') AS warnings FROM (SELECT entity_id, unnest(ws) AS x FROM w) GROUP BY 1)
       SELECT entity_id, round(sum(w * speech) / sum(w), 6) AS speech, round(sum(w * drift) / sum(w) FILTER (WHERE drift IS NOT NULL), 6) AS drift, round(sum(w * distance) / sum(w), 6) AS distance,
         bool_and(len(ws) = 0) AS all_ok, coalesce(any_value(warnings), '') AS warnings,
         CASE WHEN sum(w * distance) / sum(w) <= 20 THEN 'near' WHEN sum(w * distance) / sum(w) <= 40 THEN 'mid' ELSE 'far' END AS band
       FROM w LEFT JOIN u USING (entity_id) GROUP BY entity_id""",
)
def rollup(spark: SparkSession, sf: str) -> DataFrame:
    from rollcall.functions.quality import reasons

    told = reasons({"low_snr": F.col("snr") < 0, "far_microphone": F.col("distance") > 60})
    rows = items(spark, sf).withColumn("warnings", told).withColumn("ok", F.size("warnings") == 0).withColumn("w", F.ln(F.lit(2.0) + F.col("quality")))
    return rounded(P.quality_rollup(rows, "entity_id", ("speech", "drift", "distance"), "w", "ok", "warnings", "distance"), 6)


@query(
    "agg_evidence_curve",
    with_sql("ent", "items", more="""r AS (SELECT i.entity_id, ent.y, ent.y + (i.item_id % 9) - 4.0 AS pred, 1.0::DOUBLE + item_id % 7 AS var, 1.0::DOUBLE AS q,
           row_number() OVER (PARTITION BY i.entity_id ORDER BY day, item_id) AS rk, count(*) OVER (PARTITION BY i.entity_id) AS have FROM items i JOIN ent USING (entity_id)),
         src AS (SELECT n AS n_items, r.* FROM r CROSS JOIN (VALUES (1), (3), (5), (10)) s(n) WHERE rk <= n AND (have >= n OR n = 1)), """
             + EVIDENCE.replace("KEYS", "n_items, entity_id") + ", tr AS (SELECT n_items, entity_id, any_value(y) AS y FROM src GROUP BY 1, 2)")
    + "SELECT n_items, count(*) AS n_entities, count(*) FILTER (WHERE s = 2) AS n_used, round(avg(abs(round(mean, 2) - y)) FILTER (WHERE s = 2), 6) AS mae FROM res JOIN tr USING (n_items, entity_id) GROUP BY 1",
)
def curve(spark: SparkSession, sf: str) -> DataFrame:
    rows = lookup_join(items(spark, sf).select("entity_id", "item_id", "day"), entities(spark, sf).select("entity_id", "y"), ["entity_id"], "inner")
    rows = rows.withColumns({"pred": F.col("y") + F.col("item_id") % 9 - 4.0, "var": F.lit(1.0) + F.col("item_id") % 7})
    return rounded6(P.evidence_curve(rows, "entity_id", ("day", "item_id"), "y", "pred", "var"))
