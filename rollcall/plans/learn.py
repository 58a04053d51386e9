"""Queries for models on embedding vectors."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions.hashing import hash_uniform
from rollcall.operators import experiment as X
from rollcall.operators import learn as L
from rollcall.operators import linear as I
from rollcall.operators import stats as T
from rollcall.operators.metrics import regression_metrics
from rollcall.operators.sampling import stratified_folds
from rollcall.plans.frames import vectors
from rollcall.plans.profile import rounded
from rollcall.plans.registry import query
from rollcall.plans.tables import items, one_candidate, split_of, with_sql
from rollcall.session import new_path, settle

WIDTH = 64


def learning_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings with a numeric target, five folds stratified on the label, and a split."""
    rows = vectors(spark, sf)
    noise = hash_uniform("target", F.col("vec_id").cast("string"))
    rows = rows.withColumn("y", F.lit(150.0) + F.col("label") * 4.0 + noise * 6.0)
    folds = stratified_folds(rows, "vec_id", [F.col("label").cast("string")], 5, 3).select("vec_id", "fold")
    split = split_of(hash_uniform("vectors", F.col("vec_id").cast("string")))
    return rows.join(folds, "vec_id").withColumn("split", split)


def ml_rows(spark: SparkSession, sf: str) -> DataFrame:
    return learning_rows(spark, sf).select(
        "vec_id", "y", "fold", "split", F.lit(1.0).alias("w"), array_to_vector("v").alias("features")
    )


def fitted_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The same as entities with a source and a group, and with values missing here and there."""
    hole = F.transform("v", lambda x, i: F.when((i >= 4) | (F.abs(x) >= 0.004), x))
    return learning_rows(spark, sf).select(
        "vec_id", hole.alias("v"), "y", "fold", "split", (F.col("label") % 2).cast("int").alias("g"), F.concat(F.lit("s"), F.col("label") % 3).alias("source")
    )


_GRID = {"01": 0.1, "1": 1.0, "10": 10.0, "100": 100.0}
#: linear candidates with every step in the fold; the last cannot be fitted
CANDIDATES = (
    *[I.Candidate(f"ridge__a{n}", alpha=a) for n, a in _GRID.items()],
    *[I.Candidate(f"ridge__k32_a{n}", k=32, alpha=a) for n, a in _GRID.items()],
    *[I.Candidate(f"pca__{k}", "pca", k, 1.0) for k in (8, 24, 48)],
    *[I.Candidate(f"{w}__ridge_a{a:g}", alpha=a) for w in ("short_weighted", "medium_weighted", "short_male_weighted") for a in (1.0, 10.0)],
    I.Candidate("short_weighted__pca_24", "pca", 24, 1.0),
    I.Candidate("elastic__grid", "elastic"),
    I.Candidate("huber__135", "huber"),
    I.Candidate("pca__too_many", "pca", 500, 1.0),
)


def linear_out_of_fold(spark: SparkSession, sf: str, candidates: tuple[I.Candidate, ...]) -> tuple[DataFrame, dict[str, str]]:
    rows = settle(fitted_rows(spark, sf))
    return I.out_of_fold(rows, ["vec_id", "y"], "v", "y", "g", "fold", WIDTH, candidates)


def scored(preds: DataFrame) -> DataFrame:
    return rounded(regression_metrics(preds, ["candidate"], "y", "pred").select("candidate", "n", "mae", "rmse", "r2"), 4)


_F = ("drift", "snr", "duration")
_IMPUTED = "im AS (SELECT item_id, " + ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM tr)) AS {c}, ({c} IS NULL)::INT AS {c}_missing" for c in _F) + ", item_id % 4 <> 0 AS fit FROM it)"
_SCALED = ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM im WHERE fit)) / (SELECT stddev_pop({c}) FROM im WHERE fit), 6) AS {c}_scaled, "
    f"round(({c} - (SELECT quantile_cont({c}, 0.5) FROM im WHERE fit)) / (SELECT quantile_cont({c}, 0.9) - quantile_cont({c}, 0.1) FROM im WHERE fit), 6) AS {c}_robust, {c}_missing"
    for c in _F
)


@query(
    "ml_impute_scale",
    with_sql("items", more=f"it AS (SELECT item_id, drift, snr, CASE WHEN item_id % 9 <> 0 THEN duration END AS duration FROM items), tr AS (SELECT * FROM it WHERE item_id % 4 <> 0), {_IMPUTED}")
    + f"SELECT item_id, {_SCALED} FROM im",
)
def impute_scale(spark: SparkSession, sf: str) -> DataFrame:
    duration = F.when(F.col("item_id") % 9 != 0, F.col("duration"))
    rows = items(spark, sf).select("item_id", "drift", "snr", duration.alias("duration"))
    train = rows.filter("item_id % 4 <> 0")
    plain = L.impute_scale(rows, _F, train=train)
    both = L.impute_scale(plain, _F, robust=True, train=train, suffix="_robust")
    return rounded(both.drop(*_F), 6)


@query("ml_pca")
def pca(spark: SparkSession, sf: str) -> DataFrame:
    rows = learning_rows(spark, sf)
    out = L.pca_whitened(rows.select("vec_id", "v"), "v", 8, train=rows.filter("split = 'train'"))
    # the sign of a component is arbitrary
    return out.select("vec_id", F.posexplode("components").alias("component", "x")).select("vec_id", "component", F.round(F.abs("x"), 4).alias("size"))


@query("ml_ridge_grid")
def ridge_grid(spark: SparkSession, sf: str) -> DataFrame:
    rows = settle(learning_rows(spark, sf))
    inside, outside = rows.filter("split <> 'test'"), rows.filter("split = 'test'")
    preds = L.ridge_grid(inside, "vec_id", "v", "y", "fold", WIDTH, (0.1, 1.0, 10.0, 100.0), outside, (0.1, 0.5))
    return scored(preds)


@query("ml_huber_elastic")
def huber_elastic(spark: SparkSession, sf: str) -> DataFrame:
    chosen = tuple(c for c in CANDIDATES if c.kind in ("elastic", "huber"))
    return scored(linear_out_of_fold(spark, sf, chosen)[0])


@query("ml_trees")
def trees(spark: SparkSession, sf: str) -> DataFrame:
    chosen = {k: v for k, v in L.regressors().items() if k in ("forest", "boosted")}
    return scored(L.oof_predictions(ml_rows(spark, sf), "vec_id", "fold", chosen)[0])


@query("ml_oof_driver")
def oof(spark: SparkSession, sf: str) -> DataFrame:
    preds, failures = linear_out_of_fold(spark, sf, CANDIDATES)
    note = "; ".join(f"{n}: {m.split(':', 1)[0]}" for n, m in failures.items())
    return scored(preds).withColumn("failures", F.lit(note))


@query("ml_frozen_experiment")
def frozen(spark: SparkSession, sf: str) -> DataFrame:
    rows = settle(fitted_rows(spark, sf).drop("fold"))
    train, val, test = (rows.where(F.col("split") == s).drop("split") for s in ("train", "val", "test"))
    return rounded(X.report(X.frozen_experiment(train, val, test, CANDIDATES, WIDTH, key="vec_id")), 4)


@query("ml_fit_predict")
def fit_predict(spark: SparkSession, sf: str) -> DataFrame:
    rows = settle(fitted_rows(spark, sf))
    train, new = rows.where("split <> 'test'"), rows.where("split = 'test'").drop("y", "fold")
    out = I.refit_predict(train, new, ["vec_id"], "v", "y", "g", "fold", WIDTH, [c for c in CANDIDATES if c.name != "pca__too_many"])
    trees = ml_rows(spark, sf)
    names = ("forest", "boosted")
    more = L.fit_predict(trees.filter("split <> 'test'"), trees.filter("split = 'test'").drop("y"), "vec_id", L.regressors(), names)
    return out.unionByName(more).select("vec_id", "candidate", F.round("pred", 4).alias("pred"))


@query("ml_bundle_score")
def bundle(spark: SparkSession, sf: str) -> DataFrame:
    rows = ml_rows(spark, sf)
    train = settle(rows.filter("split = 'train'"))
    chosen = tuple(L.regressors())
    models = {n: Pipeline(stages=[L.regressors()[n]]).fit(train) for n in chosen}
    path = new_path(spark, "bundle")
    L.save_bundle(models, path)
    fresh = rows.filter("split <> 'train'").select("vec_id", "features")
    out = L.score_bundle(fresh, "vec_id", path, {"ridge": 0.4, "elastic": 0.3, "huber": 0.1, "forest": 0.1, "boosted": 0.1}, slope=1.02, intercept=-3.0, low=150.0, high=192.0, half_width=4.5)
    return rounded(out, 4)


_KEY = f"('0x' || substr(md5(concat('17:', entity_id)), 1, 8))::BIGINT % {T.PRIME}"
_MEANS = f"""k AS MATERIALIZED (SELECT e, {_KEY} AS k FROM err), n AS (SELECT r, e, {T.draws_sql("k", "r")} AS n FROM k, (SELECT range AS r FROM range(10000))),
  m AS (SELECT r, sum(n * e) / sum(n) AS mean FROM n GROUP BY r HAVING sum(n) > 0)"""


@query(
    "st_bootstrap_ci",
    with_sql("one", more=f"err AS (SELECT entity_id, abs(y - pred) AS e FROM one), {_MEANS}")
    + "SELECT round(quantile_cont(mean, 0.025), 6) AS lower_95, round(quantile_cont(mean, 0.975), 6) AS upper_95, count(*) AS repetitions, (SELECT round(avg(e), 6) FROM err) AS mae FROM m",
)
def bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.bootstrap_ci(one_candidate(spark, sf), "entity_id", "y", "pred", seed=17), 6)


@query(
    "st_paired_bootstrap",
    with_sql("preds", more=f"""w AS (SELECT entity_id, any_value(y) AS y, any_value(pred) FILTER (WHERE candidate = 'ridge__base') AS b, any_value(pred) FILTER (WHERE candidate = 'ridge__wide') AS s FROM preds GROUP BY entity_id),
      err AS (SELECT entity_id, abs(y - s) - abs(y - b) AS e FROM w), {_MEANS}""")
    + """SELECT round(quantile_cont(mean, 0.025), 6) AS lower_95, round(quantile_cont(mean, 0.975), 6) AS upper_95, avg((mean < 0)::INT) AS probability_improvement,
       count(*) AS repetitions, (SELECT round(avg(e), 6) FROM err) AS mean_delta FROM m""",
)
def paired(spark: SparkSession, sf: str) -> DataFrame:
    base = one_candidate(spark, sf)
    other = one_candidate(spark, sf, "ridge__wide").select("entity_id", F.col("pred").alias("selected"))
    return rounded(T.paired_bootstrap(base.join(other, "entity_id"), "entity_id", "y", "pred", "selected", seed=17), 6)
