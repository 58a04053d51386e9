"""Queries for blends, calibrators and recipe choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.operators import calibrate as C
from rollcall.operators import ensemble as E
from rollcall.operators.learn import mean_baseline
from rollcall.operators.metrics import regression_metrics
from rollcall.plans.metrics import METRICS
from rollcall.plans.profile import rounded
from rollcall.plans.registry import query
from rollcall.plans.tables import CANDIDATES, entities, one_candidate, predictions, with_sql
from rollcall.session import settle

NAMES = tuple(c[0] for c in CANDIDATES)
SNAPPED = ("ASIA",)
RECIPES = E.recipe_weights(
    ("ridge__base", "ridge__wide", "tree__deep"),
    {"fitted": {"ridge__base": 0.5, "ridge__wide": 0.25, "short_weighted__low": 0.25}},
)
_W = ", ".join(f"('{r}', '{n}', {w!r}::DOUBLE)" for r, ws in RECIPES.items() for n, w in ws.items())
_REC = f"rw AS (SELECT * FROM (VALUES {_W}) v(recipe, candidate, w)), bl AS (SELECT recipe, entity_id, split, source, g, y, sum(w * pred) AS pred FROM preds JOIN rw USING (candidate) GROUP BY ALL)"


@query(
    "ml_blend",
    with_sql("preds", more=_REC)
    + """, m AS (SELECT entity_id, avg(pred) AS mean_pred, quantile_cont(pred, 0.5) AS median_pred FROM preds GROUP BY 1)
       SELECT recipe, entity_id, round(b.pred, 6) AS pred, round(mean_pred, 6) AS mean_pred, round(median_pred, 6) AS median_pred, round(0.75 * b.pred + 0.25 * t.pred, 6) AS p25,
         round(0.5 * b.pred + 0.5 * t.pred, 6) AS p50, round(0.25 * b.pred + 0.75 * t.pred, 6) AS p75
       FROM bl b JOIN m USING (entity_id) JOIN preds t USING (entity_id) WHERE t.candidate = 'medium_weighted__blend'""",
)
def blended(spark: SparkSession, sf: str) -> DataFrame:
    rows = predictions(spark, sf)
    out = E.blend(rows, ["entity_id"], "candidate", "pred", RECIPES)
    members = E.member_average(rows, ["entity_id"], "pred").drop("n_members")
    external = rows.filter("candidate = 'medium_weighted__blend'").select("entity_id", F.col("pred").alias("_x"))
    out = out.join(members, "entity_id").join(external, "entity_id")
    mix = {f"p{int(w * 100)}": (1.0 - w) * F.col("pred") + w * F.col("_x") for w in (0.25, 0.5, 0.75)}
    return rounded(out.withColumns(mix).drop("_x"), 6)


@query(
    "ml_gated_blend",
    with_sql("preds")
    + """SELECT a.entity_id, round(a.pred + 0.5::DOUBLE / (1.0 + exp((a.pred - 165.0) / 3.0)) * (b.pred - a.pred), 6) AS pred
       FROM preds a JOIN preds b USING (entity_id) WHERE a.candidate = 'ridge__base' AND b.candidate = 'short_weighted__low'""",
)
def gated(spark: SparkSession, sf: str) -> DataFrame:
    base = one_candidate(spark, sf).select("entity_id", "pred")
    other = one_candidate(spark, sf, "short_weighted__low").select("entity_id", F.col("pred").alias("ext"))
    value = E.gated(F.col("pred"), F.col("ext"), F.lit(165.0), F.lit(3.0), F.lit(0.5))
    return base.join(other, "entity_id").select("entity_id", F.round(value, 6).alias("pred"))


def segment_case(kind: str, field: str | None = None) -> str:
    """CASE over the segments of a calibrator: their label, or a fixed field by label."""
    parts = []
    for s in C.SEGMENTS[kind]:
        if field is not None:
            value = getattr(s, field)
            if value is not None:
                parts.append(f"WHEN seg = '{s.name}' THEN {float(value)}::DOUBLE")
            continue
        tests = ["pred IS NOT NULL"]
        tests += [f"g = {s.group}"] if s.group is not None else []
        tests += [f"pred >= {s.low}"] if s.low is not None else []
        tests += [f"pred < {s.high}"] if s.high is not None else []
        parts.append(f"WHEN {' AND '.join(tests)} THEN '{s.name}'")
    return "CASE " + " ".join(parts) + " END"


def calibrator_ctes(kind: str, p: str) -> str:
    """CTEs that fit a calibrator on ``tr`` and apply it to ``q``; the last one is named ``p``."""
    if kind == "raw":
        return f"{p} AS (SELECT *, pred AS cal FROM q)"
    if kind in C.OFFSET_KINDS:
        off = "CASE WHEN coalesce(n, 0) >= 5 THEN n / (n + 20.0::DOUBLE) * m ELSE 0 END"
        value = {
            "global": "pred + go",
            "group": "pred + go + off",
            "group_snap": """CASE WHEN source = 'ASIA' THEN round_even((pred + go + CASE WHEN g = 1 AND pred + go < 172 AND off > 0 THEN off * least(greatest((pred + go - 162) / 10, 0.0), 1.0) ELSE off END) / 2.54::DOUBLE, 0) * 2.54::DOUBLE
              ELSE pred + go + CASE WHEN g = 1 AND pred + go < 172 AND off > 0 THEN off * least(greatest((pred + go - 162) / 10, 0.0), 1.0) ELSE off END END""",
        }[kind]
        return f"""{p}g AS (SELECT recipe, quantile_cont(y - pred, 0.5) AS go FROM tr GROUP BY 1),
          {p}o AS (SELECT recipe, source, g, count(*) AS n, quantile_cont(y - pred - go, 0.5) AS m FROM tr JOIN {p}g USING (recipe) GROUP BY 1, 2, 3),
          {p} AS (SELECT * EXCLUDE (go, off), {value} AS cal FROM (SELECT q.*, go, {off} AS off FROM q JOIN {p}g USING (recipe) LEFT JOIN {p}o USING (recipe, source, g)))"""
    slope, ic = "slope", "ic"
    for s in C.SEGMENTS[kind]:
        if s.default:
            slope = f"CASE WHEN seg = '{s.name}' AND slope IS NULL THEN {s.default[0]} ELSE slope END"
            ic = f"CASE WHEN seg = '{s.name}' AND slope IS NULL THEN {s.default[1]} ELSE ic END"
    high = segment_case(kind, "high")
    if any(s.shift is not None for s in C.SEGMENTS[kind]):
        value = f"pred - ({slope}) * ({high} - pred) - {segment_case(kind, 'shift')}"
    else:
        value = f"({slope}) * pred + ({ic})"
    if any(s.ramp is not None for s in C.SEGMENTS[kind]):
        w = f"least(greatest(({high} - pred) / {segment_case(kind, 'ramp')}, 0.0), 1.0)"
        value = f"CASE WHEN seg IS NOT NULL THEN (1.0 - {w}) * pred + {w} * ({value}) END"
    return f"""{p}s AS (SELECT *, {segment_case(kind)} AS seg FROM tr),
      {p}t AS (SELECT recipe, seg, n, CASE WHEN var > 1e-6 THEN least(greatest(cov / var, {segment_case(kind, 'slope_low')}), {segment_case(kind, 'slope_high')}) ELSE {segment_case(kind, 'flat_slope')} END AS slope
        FROM (SELECT recipe, seg, count(*) AS n, var_pop(pred) AS var, covar_samp(y, pred) AS cov FROM {p}s WHERE seg IS NOT NULL GROUP BY 1, 2) WHERE n >= {segment_case(kind, 'min_rows')}),
      {p}i AS (SELECT recipe, seg, any_value(slope) AS slope, quantile_cont(y - slope * pred, 0.5) AS ic FROM {p}s JOIN {p}t USING (recipe, seg) GROUP BY 1, 2),
      {p} AS (SELECT * EXCLUDE (seg, slope, ic), coalesce({value}, pred) AS cal FROM (SELECT *, {segment_case(kind)} AS seg FROM q) LEFT JOIN {p}i USING (recipe, seg))"""


_ONE = "tr AS (SELECT 'r' AS recipe, * FROM one WHERE split = 'train'), q AS (SELECT 'r' AS recipe, * FROM one WHERE split <> 'train')"


def register_calibrator(name: str, kinds: tuple[str, ...]) -> None:
    """One query per calibrator family: fitted on train, applied to the other splits."""
    ctes = ", ".join(calibrator_ctes(k, f"c{i}") for i, k in enumerate(kinds))
    union = " UNION ALL ".join(f"SELECT '{k}' AS kind, entity_id, round(cal, 6) AS calibrated FROM c{i}" for i, k in enumerate(kinds))

    @query(name, with_sql("one", more=f"{_ONE}, {ctes}") + union)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = settle(one_candidate(spark, sf))
        train, rest = rows.filter("split = 'train'"), rows.filter("split <> 'train'")
        out = None
        for kind in kinds:
            part = C.apply(rest, C.fit(train, kind), kind, snapped=SNAPPED).select(
                F.lit(kind).alias("kind"), "entity_id", F.round("calibrated", 6).alias("calibrated")
            )
            out = part if out is None else out.unionByName(part)
        return out


for _name, _kinds in {
    "cal_global_group_offset": ("raw", "global", "group"),
    "cal_group_snap": ("group_snap",),
    "cal_group_affine": ("gender_affine",),
    "cal_range_affine": ("range_affine",),
    "cal_short_gated": ("short_gated",),
    "cal_soft_gated": ("short_voice_calibrated", "short_male_debias"),
    "cal_physical": ("short_physical_calibrated",),
}.items():
    register_calibrator(_name, _kinds)


@query(
    "cal_linear",
    with_sql("one")
    + """, l AS (SELECT regr_slope(y, pred) AS a, regr_intercept(y, pred) AS b FROM one WHERE split = 'train')
       SELECT entity_id, round(a * pred + b, 6) AS calibrated FROM one, l WHERE split <> 'train'""",
)
def linear(spark: SparkSession, sf: str) -> DataFrame:
    rows = one_candidate(spark, sf)
    slope, intercept = C.fit_linear(rows.filter("split = 'train'"), "y", "pred")
    return rows.filter("split <> 'train'").select("entity_id", F.round(slope * F.col("pred") + intercept, 6).alias("calibrated"))


@query(
    "cal_edge_offsets",
    with_sql("one")
    + """, b AS (SELECT *, CASE WHEN pred < 160 THEN 'short' WHEN pred < 175 THEN 'medium' ELSE 'tall' END AS bin FROM one),
       o AS (SELECT bin, least(greatest(quantile_cont(y - pred, 0.5) * count(*) / (count(*) + 25.0::DOUBLE), -4.0), 4.0) AS o FROM b WHERE split = 'train' GROUP BY 1)
       SELECT entity_id, round(pred + coalesce(o, 0), 6) AS calibrated FROM b LEFT JOIN o USING (bin) WHERE split <> 'train'""",
)
def edge_offsets(spark: SparkSession, sf: str) -> DataFrame:
    rows = one_candidate(spark, sf)
    offsets = C.fit_edge_offsets(rows.filter("split = 'train'"), "y", "pred")
    out = C.apply_edge_offsets(rows.filter("split <> 'train'"), offsets, "pred", "calibrated")
    return out.select("entity_id", F.round("calibrated", 6).alias("calibrated"))


_CHOOSE = ", ".join(calibrator_ctes(k, f"k{i}") for i, k in enumerate(C.KINDS))
_ALLK = " UNION ALL ".join(
    f"SELECT concat(recipe, '__{k}') AS recipe, recipe AS base, {int(k != 'raw')} AS extra, y, cal FROM k{i}" for i, k in enumerate(C.KINDS)
)


@query(
    "ml_choose_recipe",
    with_sql("preds", more=f"{_REC}, tr AS (SELECT * FROM bl WHERE split = 'train'), q AS (SELECT * FROM bl WHERE split = 'val'), {_CHOOSE}, al AS ({_ALLK})")
    + """, nw AS (SELECT recipe AS base, count(*) AS nw FROM rw GROUP BY 1),
       m AS (SELECT recipe, round(avg(abs(cal - y)), 9) AS mae, round(coalesce(avg(abs(cal - y)) FILTER (WHERE y < 160), 0), 9) AS short_mae, max(extra + nw)::INT AS complexity FROM al JOIN nw USING (base) GROUP BY 1)
       SELECT recipe, round(mae, 4) AS mae, round(short_mae, 4) AS short_mae, complexity, recipe = (SELECT recipe FROM m WHERE mae <= (SELECT min(mae) FROM m) + 0.2 ORDER BY starts_with(recipe, 'single__'), short_mae, mae, complexity, recipe LIMIT 1) AS chosen FROM m""",
)
def choose(spark: SparkSession, sf: str) -> DataFrame:
    rows = predictions(spark, sf)
    metrics, _ = E.choose_recipe(rows.filter("split = 'train'"), rows.filter("split = 'val'"), RECIPES, snapped=SNAPPED)
    # nine digits, so that equal recipes tie in every engine
    table = settle(rounded(metrics.select("recipe", "mae", "short_mae", "complexity"), 9))
    winner = E.finalists(table).select("recipe").scalar()
    return rounded(table, 4).withColumn("chosen", F.col("recipe") == winner)


@query(
    "ml_support_rule",
    with_sql("preds")
    + """, m AS (SELECT candidate, round(avg(abs(pred - y)), 6) AS mae, round(avg(abs(pred - y)) FILTER (WHERE y < 160), 6) AS short_mae FROM preds GROUP BY 1)
       SELECT * FROM m WHERE short_mae <= (SELECT short_mae FROM m WHERE candidate LIKE 'ridge%' ORDER BY mae, short_mae LIMIT 1) + 1e-12 ORDER BY mae, short_mae, candidate LIMIT 1""",
)
def support(spark: SparkSession, sf: str) -> DataFrame:
    e = F.abs(F.col("pred") - F.col("y"))
    metrics = predictions(spark, sf).groupBy("candidate").agg(
        F.round(F.avg(e), 6).alias("mae"), F.round(F.avg(F.when(F.col("y") < 160, e)), 6).alias("short_mae")
    )
    return E.support_rule(metrics, F.col("candidate").startswith("ridge"))


@query(
    "ml_baselines",
    with_sql("ent")
    + f", preds AS (SELECT split, y, (SELECT avg(y) FROM ent WHERE split = 'train') AS pred FROM ent WHERE split <> 'train') SELECT split, {METRICS} FROM preds GROUP BY split",
)
def baselines(spark: SparkSession, sf: str) -> DataFrame:
    rows = entities(spark, sf)
    scored = mean_baseline(rows.filter("split = 'train'"), rows.filter("split <> 'train'").select("split", "y"), "y")
    return rounded(regression_metrics(scored, ["split"], "y", "pred"), 6)


def wide_train(spark: SparkSession, sf: str) -> DataFrame:
    return E.wide(predictions(spark, sf).filter("split = 'train'"), "entity_id", "candidate", "pred", NAMES, ("y", "g"))


def weight_rows(spark: SparkSession, weights: dict[str, float], table: DataFrame) -> DataFrame:
    """(candidate, weight) with the training error of the blend."""
    blend = sum((F.col(n) * F.lit(w) for n, w in weights.items()), F.lit(0.0))
    error = table.agg(F.avg(F.abs(blend - F.col("y"))).alias("mae"), F.count(F.lit(1)).alias("n"))
    pairs = F.array(*[F.struct(F.lit(n).alias("candidate"), F.lit(w).alias("weight")) for n, w in weights.items()])
    return error.select("n", "mae", F.explode(pairs).alias("_p")).select("_p.*", "n", "mae")


@query(
    "ml_select_diverse",
    with_sql("preds")
    + """, t AS (SELECT * FROM preds WHERE split = 'train'),
       m AS (SELECT candidate, avg(abs(pred - y)) AS mae, count(*) AS n FROM t GROUP BY 1),
       o AS (SELECT candidate, row_number() OVER (ORDER BY mae, candidate) AS i FROM m),
       c AS (SELECT a.candidate AS a, b.candidate AS b, corr(a.pred, b.pred) AS r FROM t a JOIN t b USING (entity_id) GROUP BY 1, 2),
       f AS (SELECT list_distinct(list_filter([(SELECT arg_min(candidate, i) FROM o WHERE contains(candidate, 'short_weighted') OR contains(candidate, 'short_male_weighted')),
         (SELECT arg_min(candidate, i) FROM o WHERE contains(candidate, 'medium_weighted')), (SELECT arg_min(candidate, i) FROM o WHERE contains(candidate, 'short_male_weighted'))], lambda x: x IS NOT NULL)) AS s),
       g AS (SELECT list_sort(list_transform(s, lambda x: [CASE WHEN contains(x, 'medium_weighted') THEN '1' ELSE '0' END, x])) AS s FROM f),
       w AS (WITH RECURSIVE st AS (
         SELECT 0::BIGINT AS i, list_transform(s, lambda x: x[2]) AS chosen FROM g
         UNION ALL
         SELECT o.i, CASE WHEN len(chosen) < 4 AND NOT list_contains(chosen, o.candidate) AND (len(chosen) = 0
             OR (SELECT min(r) FROM c WHERE c.a = o.candidate AND list_contains(st.chosen, c.b)) < 0.995
             OR NOT list_contains(list_transform(chosen, lambda x: split_part(x, '__', 1)), split_part(o.candidate, '__', 1)))
           THEN list_append(chosen, o.candidate) ELSE chosen END
         FROM st JOIN o ON o.i = st.i + 1) SELECT chosen FROM st ORDER BY i DESC LIMIT 1)
       SELECT m.candidate, list_position(chosen, m.candidate)::INT AS place, round(mae, 6) AS mae, n FROM m, w WHERE list_contains(chosen, m.candidate)""",
)
def diverse(spark: SparkSession, sf: str) -> DataFrame:
    table = settle(wide_train(spark, sf))
    error = table.agg(*[F.avg(F.abs(F.col(n) - F.col("y"))).alias(n) for n in NAMES]).first().asDict()
    chosen = E.select_diverse(error, E.correlations(table, NAMES), limit=4)
    marks = F.array(*[F.struct(F.lit(n).alias("candidate"), F.lit(i + 1).alias("place"), F.round(F.lit(error[n]), 6).alias("mae")) for i, n in enumerate(chosen)])
    return table.agg(F.count(F.lit(1)).alias("n")).select("n", F.explode(marks).alias("_m")).select("_m.*", "n")


@query("ml_convex_weights")
def convex(spark: SparkSession, sf: str) -> DataFrame:
    table = settle(wide_train(spark, sf))
    return weight_rows(spark, E.convex_weights(table, NAMES, "y", "g", short=0.5, short_group=1.5), table)


@query("ml_weight_search")
def search(spark: SparkSession, sf: str) -> DataFrame:
    table = settle(wide_train(spark, sf))
    return weight_rows(spark, E.weight_search(table, NAMES, "y", seed=7, trials=5000), table)
