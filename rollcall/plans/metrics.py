"""Queries for metrics, windows, top-k and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions import numbers as N
from rollcall.operators import audit as A
from rollcall.operators import ensemble as E
from rollcall.operators import gates as G
from rollcall.operators import metrics as M
from rollcall.operators import rules as R
from rollcall.operators import windows as W
from rollcall.operators.calibrate import hierarchical_prior
from rollcall.operators.grouped import first_n
from rollcall.plans.frames import vectors
from rollcall.plans.profile import rounded
from rollcall.plans.registry import query
from rollcall.plans.rules import _MEASURED, measured, qc_rules
from rollcall.plans.tables import entities, items, load, one_candidate, predictions, with_sql

METRICS = """count(*) AS n, round(avg(abs(pred - y)), 6) AS mae, round(sqrt(avg(pow(pred - y, 2))), 6) AS rmse, round(max(abs(pred - y)), 6) AS max_ae, round(avg(pred - y), 6) AS bias,
  round(avg((abs(pred - y) <= 2)::INT), 6) AS within_2, round(avg((abs(pred - y) <= 3)::INT), 6) AS within_3, round(avg((abs(pred - y) <= 4)::INT), 6) AS within_4, round(avg((abs(pred - y) <= 5)::INT), 6) AS within_5,
  round(CASE WHEN count(*) > 1 AND var_pop(y) > 0 THEN 1.0 - sum(pow(pred - y, 2)) / (count(*) * var_pop(y)) END, 6) AS r2,
  round(quantile_cont(abs(pred - y), 0.5), 6) AS median_ae, round(quantile_cont(abs(pred - y), 0.9), 6) AS p90_ae"""
_BIN = "CASE WHEN y < 160 THEN 'short' WHEN y < 175 THEN 'medium' ELSE 'tall' END"
_QUAL = "CASE WHEN entity_id % 10 < 5 THEN 'low' WHEN entity_id % 10 < 7 THEN 'medium' ELSE 'high' END"
_SLICES = f"""sl AS (SELECT * EXCLUDE (_s), _s.d AS slice_dim, _s.v AS slice_value FROM (SELECT *, unnest([{{'d': 'all', 'v': 'all'}}, {{'d': 'source', 'v': source}}, {{'d': 'group', 'v': g::VARCHAR}},
  {{'d': 'target', 'v': {_BIN}}}, {{'d': 'quality', 'v': {_QUAL}}}, {{'d': 'short_group', 'v': CASE WHEN y < 160 THEN concat('short_', g) END}}]) AS _s FROM preds) WHERE _s.v IS NOT NULL)"""


def slices() -> dict:
    step = F.col("entity_id") % 10
    return {
        "source": F.col("source"), "group": F.col("g"), "target": N.target_bin(F.col("y")),
        "quality": F.when(step < 5, "low").when(step < 7, "medium").otherwise("high"),
        "short_group": F.when(F.col("y") < 160, F.concat(F.lit("short_"), F.col("g").cast("string"))),
    }


@query(
    "entry_prior_slices",
    with_sql("ent")
    + """, tr AS (SELECT * FROM ent WHERE split = 'train'), te AS (SELECT * FROM ent WHERE split = 'test'),
       t1 AS (SELECT source, quantile_cont(y, 0.5) AS m, count(*) AS n FROM tr GROUP BY 1), t2 AS (SELECT source, segment, quantile_cont(y, 0.5) AS m, count(*) AS n FROM tr GROUP BY 1, 2),
       p AS (SELECT te.source, te.segment, te.y, (SELECT quantile_cont(y, 0.5) FROM tr) AS g0, t1.m AS m1, t1.n AS n1, t2.m AS m2, t2.n AS n2 FROM te LEFT JOIN t1 USING (source) LEFT JOIN t2 ON te.source = t2.source AND te.segment = t2.segment),
       q AS (SELECT *, coalesce((1 - n1 / (n1 + 12.0)) * g0 + n1 / (n1 + 12.0) * m1, g0) AS p1 FROM p),
       r AS (SELECT *, coalesce((1 - n2 / (n2 + 12.0)) * p1 + n2 / (n2 + 12.0) * m2, p1) AS pred FROM q)
       SELECT CASE WHEN grouping(source) = 1 AND grouping(segment) = 1 THEN 'all' WHEN grouping(segment) = 1 THEN 'source' WHEN grouping(source) = 1 THEN 'segment' ELSE 'source_segment' END AS slice_dim,
         coalesce(source || CASE WHEN segment IS NOT NULL THEN ':' || segment ELSE '' END, segment, 'all') AS slice_value, """
    + METRICS
    + " FROM r GROUP BY GROUPING SETS ((), (source), (segment), (source, segment))",
)
def prior_slices(spark: SparkSession, sf: str) -> DataFrame:
    rows = entities(spark, sf).select("entity_id", "source", "segment", "y", "split")
    scored = hierarchical_prior(
        rows.filter("split = 'train'"), rows.filter("split = 'test'"), [("source",), ("source", "segment")], "y", "pred"
    )
    by = {"source": F.col("source"), "segment": F.col("segment"), "source_segment": F.concat_ws(":", "source", "segment")}
    return rounded(M.sliced_metrics(scored, by, "y", "pred"), 6)


@query("agg_regression_metrics", with_sql("preds") + f"SELECT candidate, split, {METRICS} FROM preds GROUP BY 1, 2")
def regression(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.regression_metrics(predictions(spark, sf), ["candidate", "split"], "y", "pred"), 6)


@query(
    "agg_sliced_metrics",
    with_sql("preds", more=_SLICES) + f"SELECT candidate, slice_dim, slice_value, {METRICS} FROM sl GROUP BY 1, 2, 3",
)
def sliced(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.sliced_metrics(predictions(spark, sf), slices(), "y", "pred", ("candidate",)), 6)


@query(
    "agg_edge_metrics",
    with_sql("preds")
    + """SELECT candidate, round(s, 6) AS short_mae, round(t, 6) AS tall_mae, round((s + t) / 2, 6) AS edge_mae, round(greatest(s, t), 6) AS edge_worst_mae FROM (
         SELECT candidate, avg(abs(pred - y)) FILTER (WHERE y < 160) AS s, avg(abs(pred - y)) FILTER (WHERE y >= 175) AS t FROM preds GROUP BY 1)""",
)
def edges(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.edge_metrics(predictions(spark, sf), ["candidate"], "y", "pred"), 6)


_MAES = "mm AS (SELECT candidate, split, slice_dim, slice_value, avg(abs(pred - y)) AS mae FROM sl GROUP BY 1, 2, 3, 4)"
_GUARD = """gd AS (SELECT candidate, split, max(mae) FILTER (WHERE slice_dim = 'all') AS o, max(mae) FILTER (WHERE slice_dim = 'target' AND slice_value = 'short') AS s,
  max(mae) FILTER (WHERE slice_dim = 'target' AND slice_value = 'medium') AS m, max(mae) FILTER (WHERE slice_dim = 'target' AND slice_value = 'tall') AS t,
  max(mae) FILTER (WHERE slice_dim = 'quality' AND slice_value = 'medium') AS q FROM mm GROUP BY 1, 2),
gm AS (SELECT candidate, split, o AS overall, s AS short, (o + s + m + t) / 4 AS balanced, o + 0.35 * greatest(s - o, 0) + 0.20 * greatest(q - o, 0) + 0.10 * greatest(t - o, 0) AS guarded FROM gd)"""


def sliced_mae(spark: SparkSession, sf: str) -> DataFrame:
    long = M.slice_rows(predictions(spark, sf), {"all": F.lit("all"), **slices()}, ("candidate", "split", "y", "pred"))
    return long.groupBy("candidate", "split", "slice_dim", "slice_value").agg(F.avg(F.abs(F.col("pred") - F.col("y"))).alias("mae"))


@query(
    "agg_guard_metrics",
    with_sql("preds", more=f"{_SLICES}, {_MAES}, {_GUARD}")
    + "SELECT candidate, split, round(overall, 6) AS overall, round(balanced, 6) AS balanced, round(guarded, 6) AS guarded FROM gm",
)
def guards(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.guard_metrics(sliced_mae(spark, sf), ["candidate", "split"]), 6)


@query(
    "agg_classification",
    """WITH d AS (SELECT quality AS y, CASE WHEN n_chars > 400 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)),
       c AS (SELECT k.c AS cls, count(*) FILTER (WHERE y = k.c) AS support, count(*) FILTER (WHERE p = k.c) AS np, count(*) FILTER (WHERE y = k.c AND p = k.c) AS hits FROM d, (VALUES (0), (1)) k(c) GROUP BY 1)
       SELECT cls, support, round(coalesce(hits / nullif(np, 0), 0), 6) AS precision, round(coalesce(hits / nullif(support, 0), 0), 6) AS recall, round(2.0 * hits / (np + support), 6) AS f1,
         round((SELECT avg((y = p)::INT) FROM d), 6) AS accuracy FROM c""",
)
def classification(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "labels").join(load(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = rows.select(F.col("quality").alias("y"), (F.col("n_chars") > 400).cast("int").alias("p"))
    return rounded(M.classification(rows, "y", "p"), 6)


@query(
    "agg_calibration",
    with_sql("preds")
    + """, s AS (SELECT *, abs(pred - y) AS e, 1.0::DOUBLE + entity_id % 9 AS sd FROM preds)
       SELECT candidate, count(*) AS n, round(avg(abs(sd - e)), 6) AS calibration_mae, round(corr(sd, e), 6) AS error_corr, round(avg((e <= sd)::INT), 6) AS interval_68,
         round(avg((e <= 1.96 * sd)::INT), 6) AS interval_95, round(avg(sd), 6) AS std_mean FROM s GROUP BY 1""",
)
def calibration(spark: SparkSession, sf: str) -> DataFrame:
    rows = predictions(spark, sf).withColumn("sd", F.lit(1.0) + F.col("entity_id") % 9)
    return rounded(M.calibration_metrics(rows, ["candidate"], "y", "pred", "sd"), 6)


@query(
    "agg_multi_seed",
    with_sql("preds")
    + """, r AS (SELECT candidate, entity_id % 5 AS seed, 'mae' AS metric, avg(abs(pred - y)) AS v FROM preds GROUP BY 1, 2 UNION ALL SELECT candidate, entity_id % 5, 'bias', avg(pred - y) FROM preds GROUP BY 1, 2)
       SELECT candidate, metric, count(DISTINCT seed) AS n_runs, round(avg(v), 6) AS mean, round(coalesce(stddev_pop(v), 0), 6) AS std FROM r GROUP BY 1, 2""",
)
def multi_seed(spark: SparkSession, sf: str) -> DataFrame:
    err = F.col("pred") - F.col("y")
    runs = predictions(spark, sf).groupBy("candidate", (F.col("entity_id") % 5).alias("seed")).agg(F.avg(F.abs(err)).alias("mae"), F.avg(err).alias("bias"))
    long = runs.unpivot(["candidate", "seed"], ["mae", "bias"], "metric", "v")
    return rounded(M.multi_seed(long, "candidate", "seed", "metric", "v"), 6)


@query(
    "agg_overfit_gap",
    with_sql("preds", more=f"{_SLICES}, {_MAES}")
    + """SELECT candidate, slice_dim, slice_value, round(t, 6) AS train, round(v, 6) AS val, round(v - t, 6) AS gap FROM (SELECT candidate, slice_dim, slice_value,
         max(mae) FILTER (WHERE split = 'train') AS t, max(mae) FILTER (WHERE split = 'val') AS v FROM mm GROUP BY 1, 2, 3)""",
)
def overfit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.overfit_gap(sliced_mae(spark, sf), ["candidate", "slice_dim", "slice_value"], "split", "mae"), 6)


@query(
    "agg_slice_spread",
    with_sql("preds", more=f"{_SLICES}, {_MAES}")
    + """, w AS (SELECT max(b.mae - a.mae) AS w FROM mm a JOIN mm b USING (split, slice_dim, slice_value) WHERE split = 'val' AND slice_dim <> 'all' AND a.candidate = 'ridge__base' AND b.candidate = 'tree__deep')
       SELECT candidate, slice_dim, round(max(mae) - min(mae), 6) AS spread, count(*) AS n_slices, round((SELECT w FROM w), 6) AS worst_degradation
       FROM mm WHERE split = 'val' AND slice_dim <> 'all' GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def spread(spark: SparkSession, sf: str) -> DataFrame:
    rows = sliced_mae(spark, sf).filter("split = 'val'")
    worst = M.worst_degradation(rows, "candidate", "ridge__base", "tree__deep").select("worst_degradation").scalar()
    return rounded(M.slice_spread(rows, ["candidate"]).withColumn("worst_degradation", worst), 6)


@query(
    "agg_hierarchical_median",
    with_sql("ent")
    + """, tr AS (SELECT * FROM ent WHERE split = 'train'), a AS (SELECT g, quantile_cont(y, 0.5) AS m, count(*) AS n FROM tr GROUP BY 1), b AS (SELECT source, quantile_cont(y, 0.5) AS m, count(*) AS n FROM tr GROUP BY 1),
       c AS (SELECT g, source, quantile_cont(y, 0.5) AS m, count(*) AS n FROM tr GROUP BY 1, 2), d AS (SELECT g, source, segment, quantile_cont(y, 0.5) AS m, count(*) AS n FROM tr GROUP BY 1, 2, 3),
       e AS (SELECT g, source, age, quantile_cont(y, 0.5) AS m, count(*) AS n FROM tr GROUP BY 1, 2, 3),
       j0 AS (SELECT entity_id, g, source, segment, age, (SELECT quantile_cont(y, 0.5) FROM tr) AS p FROM ent),
       j1 AS (SELECT j0.* REPLACE (coalesce((1 - n / (n + 12.0)) * p + n / (n + 12.0) * m, p) AS p) FROM j0 LEFT JOIN a USING (g)),
       j2 AS (SELECT j1.* REPLACE (coalesce((1 - n / (n + 12.0)) * p + n / (n + 12.0) * m, p) AS p) FROM j1 LEFT JOIN b USING (source)),
       j3 AS (SELECT j2.* REPLACE (coalesce((1 - n / (n + 12.0)) * p + n / (n + 12.0) * m, p) AS p) FROM j2 LEFT JOIN c USING (g, source)),
       j4 AS (SELECT j3.* REPLACE (coalesce((1 - n / (n + 12.0)) * p + n / (n + 12.0) * m, p) AS p) FROM j3 LEFT JOIN d USING (g, source, segment)),
       j5 AS (SELECT j4.* REPLACE (coalesce((1 - n / (n + 12.0)) * p + n / (n + 12.0) * m, p) AS p) FROM j4 LEFT JOIN e USING (g, source, age))
       SELECT entity_id, round(p, 6) AS prior FROM j5""",
)
def hierarchical(spark: SparkSession, sf: str) -> DataFrame:
    rows = entities(spark, sf).select("entity_id", "g", "source", "segment", "age", "y", "split")
    levels = [("g",), ("source",), ("g", "source"), ("g", "source", "segment"), ("g", "source", "age")]
    out = hierarchical_prior(rows.filter("split = 'train'"), rows, levels, "y")
    return out.select("entity_id", F.round("prior", 6).alias("prior"))


@query(
    "win_first_n",
    with_sql("items") + "SELECT entity_id, item_id FROM items QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY day, item_id) <= 3",
)
def first_items(spark: SparkSession, sf: str) -> DataFrame:
    return first_n(items(spark, sf).select("entity_id", "item_id", "day"), ["entity_id"], ["day", "item_id"], 3).select("entity_id", "item_id")


@query(
    "win_keep_first",
    with_sql("items", more=_MEASURED)
    + """, x AS (SELECT item_id, entity_id, (item_id % 4)::VARCHAR AS digest, day, CASE WHEN len(f) > 0 THEN f[1] END AS reason FROM qc)
       SELECT item_id, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY entity_id, digest, reason IS NULL ORDER BY day, item_id) > 1 THEN 'duplicate_within_entity' ELSE reason END AS reason FROM x""",
)
def keep_first(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.with_reason(measured(spark, sf), qc_rules())
    rows = rows.select("item_id", "entity_id", "day", "reason", (F.col("item_id") % 4).cast("string").alias("digest"))
    return W.keep_first(rows, "entity_id", "digest", ("day", "item_id")).select("item_id", "reason")


@query(
    "win_rank_candidates",
    with_sql("preds")
    + """, c AS (SELECT concat(candidate, '@', segment) AS candidate, round(avg(abs(pred - y)), 6) AS mae, round(avg(abs(pred - y)) FILTER (WHERE y < 160), 6) AS short_mae FROM preds GROUP BY 1)
       SELECT candidate, mae, short_mae, row_number() OVER (ORDER BY mae, short_mae, candidate)::INT AS rank FROM c QUALIFY rank <= 12""",
)
def rank_candidates(spark: SparkSession, sf: str) -> DataFrame:
    e = F.abs(F.col("pred") - F.col("y"))
    scored = predictions(spark, sf).groupBy(F.concat("candidate", F.lit("@"), "segment").alias("candidate")).agg(
        F.round(F.avg(e), 6).alias("mae"), F.round(F.avg(F.when(F.col("y") < 160, e)), 6).alias("short_mae")
    )
    return W.ranked_top(scored, ["mae", "short_mae", "candidate"], 12)


_BEST = """s AS (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events),
  b AS (SELECT *, min(v) OVER w AS best, min(v) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM s WINDOW w AS (PARTITION BY user_id ORDER BY step)),
  f AS (SELECT *, v IS NOT NULL AND (prior IS NULL OR v < prior) AS is_best FROM b),
  r AS (SELECT *, max(CASE WHEN is_best THEN step END) OVER (PARTITION BY user_id ORDER BY step) AS best_at FROM f)"""


def metric_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a metric log: run = user, step = event order, error events have no value."""
    return load(spark, sf, "events").select(
        "user_id", "event_id", "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("v")
    )


@query(
    "win_running_best",
    f"WITH {_BEST} SELECT event_id, step, best, is_best, step - best_at AS since_best, coalesce(v <= 2.0, FALSE) AS reached, coalesce(step - best_at >= 3, FALSE) AS stop FROM r",
)
def running_best(spark: SparkSession, sf: str) -> DataFrame:
    out = W.running_best(metric_log(spark, sf), "user_id", ("ts", "event_id"), "v", target=2.0, patience=3)
    return out.select("event_id", "step", "best", "is_best", "since_best", "reached", "stop")


@query(
    "gate_stop_status",
    """SELECT user_id, count(*) AS n_steps, arg_max(v, (ts, event_id)) AS latest, min(v) AS best, coalesce(bool_or(v <= 2.0), FALSE) AS reached,
         coalesce(min(v) <= 2.0, FALSE) AS stop_min, coalesce(max(v) >= 60.0, FALSE) AS stop_max FROM (SELECT user_id, event_id, ts, value AS v FROM events) GROUP BY 1""",
)
def stop_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").select("user_id", "event_id", "ts", F.col("value").alias("v"))
    state = W.latest_state(rows, "user_id", ("ts", "event_id"), "v", 2.0)
    top = rows.groupBy("user_id").agg(F.max("v").alias("_top"))
    return state.join(top, "user_id").withColumns(
        {"stop_min": G.stop_status(F.col("best"), 2.0), "stop_max": G.stop_status(F.col("_top"), 60.0, "max")}
    ).drop("_top")


@query(
    "win_stratum_rank",
    with_sql("ent")
    + "SELECT entity_id, row_number() OVER (PARTITION BY source, segment ORDER BY md5(concat('7:', entity_id)), entity_id) AS pos, count(*) OVER (PARTITION BY source, segment) AS n FROM ent",
)
def stratum_rank(spark: SparkSession, sf: str) -> DataFrame:
    from rollcall.functions.hashing import hash_order
    from rollcall.operators.grouped import attach, positions

    rows = entities(spark, sf).select("entity_id", "source", "segment").withColumn("_h", hash_order(7, F.col("entity_id").cast("string")))
    known = rows.count()
    ranked = positions(rows, ["source", "segment"], ["_h", "entity_id"], "pos", known)
    return attach(ranked, ["source", "segment"], {"n": F.count(F.lit(1))}, known).select("entity_id", "pos", "n")


@query(
    "win_running_bin_error",
    with_sql("items")
    + """, b AS (SELECT label, CASE WHEN pred < 165 THEN 'short' WHEN pred < 178 THEN 'medium' ELSE 'tall' END AS bin, day, avg(abs(pred - 170)) AS e FROM items GROUP BY 1, 2, 3),
       k AS (SELECT *, row_number() OVER (PARTITION BY label, bin ORDER BY day) AS k, count(*) OVER (PARTITION BY label, bin) AS t FROM b)
       SELECT label, bin, round(sum(e * pow(0.9::DOUBLE, t - k) * CASE WHEN k = 1 THEN 1 ELSE 0.1::DOUBLE END), 6) AS moving_error, any_value(t) AS n_updates FROM k GROUP BY 1, 2""",
)
def bin_error(spark: SparkSession, sf: str) -> DataFrame:
    bins = N.label_bins(F.col("pred"), (165.0, 178.0), ("short", "medium", "tall"))
    rows = items(spark, sf).select("label", bins.alias("bin"), "day", (F.col("pred") - 170.0).alias("e"))
    return rounded(W.moving_error(rows, ("label", "bin"), ("day",), "e", 0.9), 6)


@query(
    "top_examples",
    """SELECT source, count(*) AS n, array_to_string(list_sort(list(doc_id))[1:10], '|') AS examples FROM documents GROUP BY source""",
)
def top_examples(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "documents").select("source", "doc_id")
    return A.examples(rows, ["source"], "doc_id", 10)


_RECIPES = """rec AS (SELECT concat(CASE WHEN candidate LIKE 'ridge%' THEN 'single__' ELSE 'mix__' END, candidate, '__', source) AS recipe, round(avg(abs(pred - y)), 6) AS mae,
  round(coalesce(avg(abs(pred - y)) FILTER (WHERE y < 160), 0), 6) AS short_mae, any_value(length(candidate))::INT AS complexity FROM preds WHERE split = 'val' GROUP BY 1)"""


def recipe_metrics(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.when(F.col("candidate").startswith("ridge"), "single__").otherwise("mix__"), "candidate", F.lit("__"), "source")
    e = F.abs(F.col("pred") - F.col("y"))
    return predictions(spark, sf).filter("split = 'val'").groupBy(name.alias("recipe")).agg(
        F.round(F.avg(e), 6).alias("mae"), F.round(F.coalesce(F.avg(F.when(F.col("y") < 160, e)), F.lit(0.0)), 6).alias("short_mae"),
        F.max(F.length("candidate")).alias("complexity"),
    )


@query("top_recipes", with_sql("preds", more=_RECIPES) + "SELECT recipe, mae FROM rec ORDER BY mae, recipe LIMIT 10")
def top_recipes(spark: SparkSession, sf: str) -> DataFrame:
    return recipe_metrics(spark, sf).select("recipe", "mae").orderBy("mae", "recipe").limit(10)


@query(
    "top_finalists",
    with_sql("preds", more=_RECIPES)
    + "SELECT * FROM rec WHERE mae <= (SELECT min(mae) FROM rec) + 0.4 ORDER BY starts_with(recipe, 'single__'), short_mae, mae, complexity, recipe LIMIT 5",
)
def top_finalists(spark: SparkSession, sf: str) -> DataFrame:
    return E.finalists(recipe_metrics(spark, sf), tolerance=0.4, limit=5)


@query("top_tail", "SELECT event_id, user_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 40")
def top_tail(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(40).select("event_id", "user_id", "value")


@query(
    "top_select_k",
    """WITH l AS (SELECT label::DOUBLE AS y, (i - 1)::INT AS dim, x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)),
       r AS (SELECT dim, corr(x, y) AS r, count(*) AS n FROM l GROUP BY 1)
       SELECT dim, round(r, 6) AS r, n, round(r * r / (1 - r * r) * (n - 2), 6) AS f FROM r ORDER BY r * r / (1 - r * r) * (n - 2) DESC LIMIT 16""",
)
def select_k(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(W.select_k(vectors(spark, sf), "v", "label", 16), 6)


@query(
    "st_error_budget",
    with_sql("one")
    + """SELECT count(*) AS n, round(sum(abs(pred - y)), 6) AS total_error, (count(*) * 3.0::DOUBLE) AS budget, round(sum(abs(pred - y)) - count(*) * 3.0, 6) AS gap,
         round(sum(abs(pred - y)) FILTER (WHERE y < 160), 6) AS slice_error, round((sum(abs(pred - y)) - sum(abs(pred - y)) FILTER (WHERE y < 160)) / count(*), 6) AS mae_if_slice_perfect FROM one""",
)
def budget(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.error_budget(one_candidate(spark, sf), "y", "pred", 3.0, F.col("y") < 160.0), 6)


LIMITS = {"overall": ("max", 3.0), "balanced": ("max", 3.2), "guarded": ("min", 3.0)}
_LONGGM = "lg AS (SELECT candidate, split, unnest([{'metric': 'overall', 'value': overall}, {'metric': 'balanced', 'value': balanced}, {'metric': 'guarded', 'value': guarded}, {'metric': 'short', 'value': short}], recursive := true) FROM gm)"


@query(
    "gate_targets",
    with_sql("preds", more=f"{_SLICES}, {_MAES}, {_GUARD}, {_LONGGM}")
    + """SELECT candidate, split, metric, round(value, 6) AS value, CASE metric WHEN 'balanced' THEN 3.2::DOUBLE ELSE 3.0 END AS "limit",
         CASE metric WHEN 'overall' THEN value <= 3.0 WHEN 'balanced' THEN value <= 3.2 ELSE value >= 3.0 END AS met FROM lg WHERE metric <> 'short'""",
)
def gate_targets(spark: SparkSession, sf: str) -> DataFrame:
    table = M.guard_metrics(sliced_mae(spark, sf), ["candidate", "split"])
    long = table.unpivot(["candidate", "split"], ["overall", "balanced", "guarded"], "metric", "value")
    return rounded(G.target_gate(long, "metric", "value", LIMITS), 6, keep=("limit",))


GATES = {"sealed_test_speaker_mae": 3.0, "short_tail_speaker_mae": 4.0, "balanced_speaker_mae": 3.5, "val_test_gap": 0.2}


@query(
    "gate_multi",
    with_sql("preds", more=f"{_SLICES}, {_MAES}, {_GUARD}, {_LONGGM}")
    + """, fam AS (SELECT CASE WHEN candidate LIKE 'ridge%' THEN 'ridge' ELSE 'other' END AS run, split, CASE metric WHEN 'overall' THEN 'mae' ELSE metric END AS metric, value FROM lg WHERE metric <> 'guarded'),
       w AS (SELECT run, least(min(value) FILTER (WHERE split = 'val' AND metric = 'mae'), min(value) FILTER (WHERE split = 'val' AND metric = 'balanced')) AS val, min(value) FILTER (WHERE split = 'test' AND metric = 'mae') AS test,
         min(value) FILTER (WHERE split = 'test' AND metric = 'balanced') AS bal, min(value) FILTER (WHERE split = 'test' AND metric = 'short') AS short FROM fam GROUP BY 1),
       c AS (SELECT run, unnest([{'check': 'sealed_test_speaker_mae', 'value': test, 'threshold': 3.0::DOUBLE}, {'check': 'short_tail_speaker_mae', 'value': short, 'threshold': 4.0::DOUBLE},
         {'check': 'balanced_speaker_mae', 'value': bal, 'threshold': 3.5::DOUBLE}, {'check': 'val_test_gap', 'value': test - val, 'threshold': 0.2::DOUBLE}], recursive := true) FROM w)
       SELECT run, "check", round(value, 6) AS value, threshold, CASE WHEN value <= threshold THEN 'PASS' ELSE 'BLOCK' END AS verdict FROM c""",
)
def gate_multi(spark: SparkSession, sf: str) -> DataFrame:
    rows = sliced_mae(spark, sf)
    guard = M.guard_metrics(rows, ["candidate", "split"]).unpivot(["candidate", "split"], ["overall", "balanced"], "metric", "value")
    short = rows.filter("slice_dim = 'target' AND slice_value = 'short'").select("candidate", "split", F.lit("short").alias("metric"), F.col("mae").alias("value"))
    ridge = F.col("candidate").startswith("ridge")
    wide = F.when(F.col("metric") == "overall", "mae").otherwise(F.col("metric"))
    variant = F.when(F.col("candidate").endswith("wide"), F.concat(wide, F.lit("_omega"))).otherwise(wide)
    long = guard.unionByName(short).select(F.when(ridge, "ridge").otherwise("other").alias("run"), "split", variant.alias("metric"), "value")
    return rounded(G.multi_gate(long, "run", GATES), 6)


@query(
    "gate_promotion",
    with_sql("preds", more=f"{_SLICES}, {_MAES}")
    + """, m AS (SELECT slice_value AS source, max(mae) FILTER (WHERE candidate = 'tree__deep' AND split = 'val') AS ov, max(mae) FILTER (WHERE candidate = 'ridge__base' AND split = 'val') AS nv,
         max(mae) FILTER (WHERE candidate = 'tree__deep' AND split = 'test') AS ot, max(mae) FILTER (WHERE candidate = 'ridge__base' AND split = 'test') AS nt FROM mm WHERE slice_dim = 'source' GROUP BY 1),
       w AS (SELECT max(b.mae - a.mae) AS w FROM mm a JOIN mm b USING (split, slice_dim, slice_value) WHERE split = 'val' AND slice_dim <> 'all' AND a.candidate = 'tree__deep' AND b.candidate = 'ridge__base')
       SELECT source, round(ov - nv, 6) AS val_gain, round(ot - nt, 6) AS test_gain, round(w, 6) AS worst, CASE WHEN ov - nv IS NULL OR ot - nt IS NULL THEN 'hold'
         WHEN ov - nv >= 0.1 AND ot - nt >= 0.1 AND (w IS NULL OR w <= 0.3) THEN 'promote' ELSE 'kill' END AS decision FROM m, w""",
)
def gate_promotion(spark: SparkSession, sf: str) -> DataFrame:
    rows = sliced_mae(spark, sf)
    worst = M.worst_degradation(rows.filter("split = 'val'"), "candidate", "tree__deep", "ridge__base").select("worst_degradation").scalar()
    cell = lambda c, s: F.max(F.when((F.col("candidate") == c) & (F.col("split") == s), F.col("mae")))
    wide = rows.filter("slice_dim = 'source'").groupBy(F.col("slice_value").alias("source")).agg(
        cell("tree__deep", "val").alias("ov"), cell("ridge__base", "val").alias("nv"), cell("tree__deep", "test").alias("ot"), cell("ridge__base", "test").alias("nt")
    ).withColumn("worst", worst)
    out = G.promotion(wide, "ov", "nv", "ot", "nt", "worst")
    return rounded(out.select("source", "val_gain", "test_gain", "worst", "decision"), 6)


@query(
    "gate_registry",
    with_sql("preds")
    + """SELECT segment AS stage, candidate AS variant, 11 AS seed, 2 AS run_no, round(avg(abs(pred - y)), 6) AS mae, 'rerun' AS notes FROM preds WHERE split = 'val' AND candidate LIKE 'ridge%' GROUP BY 1, 2
         UNION ALL SELECT segment, candidate, 11, 1, round(avg(abs(pred - y)), 6), 'first' FROM preds WHERE split = 'train' AND candidate NOT LIKE 'ridge%' GROUP BY 1, 2""",
)
def registry(spark: SparkSession, sf: str) -> DataFrame:
    from rollcall.session import new_path

    def records(split: str, run: int, notes: str) -> DataFrame:
        return predictions(spark, sf).filter(F.col("split") == split).groupBy(F.col("segment").alias("stage"), F.col("candidate").alias("variant")).agg(
            F.round(F.avg(F.abs(F.col("pred") - F.col("y"))), 6).alias("mae")
        ).select("stage", "variant", F.lit(11).alias("seed"), F.lit(run).alias("run_no"), "mae", F.lit(notes).alias("notes"))

    path = new_path(spark, "registry")
    G.append_registry(records("train", 1, "first"), path)
    G.append_registry(records("val", 2, "rerun").filter("variant LIKE 'ridge%'"), path)
    return G.latest_registry(spark.read.parquet(path), ["stage", "variant", "seed"], "run_no")
