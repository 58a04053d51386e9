"""The frozen experiment: choose on training and validation rows, refit, and look at the test rows once.

Out-of-fold predictions of fitted candidates are written; the shortlist, the convex
weights, the recipe and its calibrator come from them and from the validation
predictions.  Then components, weights and calibrator are refitted on training and
validation rows together, and the test rows are predicted and scored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.operators import calibrate as C
from rollcall.operators import ensemble as E
from rollcall.operators import linear as L
from rollcall.operators.metrics import regression_metrics, sliced_metrics
from rollcall.operators.sampling import stratified_folds
from rollcall.operators.stats import bootstrap_ci
from rollcall.session import settle


@dataclass
class Experiment:
    """What was found and chosen; tables are written ones or small aggregates of them."""

    candidate_metrics: DataFrame
    failures: dict[str, str]
    shortlist: list[str]
    oof_weights: dict[str, float]
    recipe_metrics: DataFrame
    recipe: str
    calibrator: str
    #: weights of the components after the refit
    weights: dict[str, float]
    validation: DataFrame
    test: DataFrame
    test_metrics: DataFrame
    test_interval: DataFrame
    test_slices: DataFrame


def with_folds(rows: DataFrame, key: str, strata: Sequence[Column], folds: int, seed: int) -> DataFrame:
    """Rows with the number of the stratified fold that holds them out, written."""
    numbers = stratified_folds(rows, key, strata, folds, seed).select(key, "fold")
    return settle(rows.drop("fold").join(numbers, key))


def frozen_experiment(
    train: DataFrame, val: DataFrame, test: DataFrame, candidates: Sequence[L.Candidate], width: int, key: str = "entity_id", vector: str = "v",
    y: str = "y", group: str = "g", source: str = "source", folds: int = 5, seed: int = 42, limit: int = 10, kinds: Sequence[str] = C.KINDS,
    snapped: Sequence[str] = (), slices: Mapping[str, Column] | None = None, repetitions: int = 10_000,
) -> Experiment:
    """Run the experiment on three disjoint tables of (key, vector, y, group, source).

    Candidates that cannot be fitted are reported in ``failures``; a chosen one that
    fails in the refit is an error.  Targets of the test rows enter its metrics alone.
    """
    by_name = {c.name: c for c in candidates}
    keep = [key, y, group, source]
    plain = [F.col(key), F.col(y).alias("y"), F.col(group).alias("g"), F.col(source).alias("source"), "candidate", "pred"]
    strata = [F.concat_ws(":", F.col(source), F.col(group).cast("string"))]

    # choose on the training rows, out of fold
    first = with_folds(train, key, strata, folds, seed)
    oof, failures = L.out_of_fold(first, keep, vector, y, group, "fold", width, candidates)
    oof = settle(oof.select(*plain))
    metrics = settle(regression_metrics(oof, ["candidate"], "y", "pred"))
    maes = {r["candidate"]: r["mae"] for r in metrics.select("candidate", "mae").collect()}
    table = settle(E.wide(oof, key, "candidate", "pred", sorted(maes), ("y", "g")))
    shortlist = E.select_diverse(maes, E.correlations(table, sorted(maes)), limit=limit)
    weights = E.convex_weights(table, shortlist, "y", "g")

    # choose the recipe and its calibrator on the validation rows
    chosen = [by_name[n] for n in shortlist]
    found = L.refit_predict(first, val, keep, vector, y, group, "fold", width, chosen)
    found = settle(found.select(*plain))
    recipes = E.recipe_weights(shortlist, {"convex": weights})
    scores, scored = E.choose_recipe(oof, found, recipes, kinds, key, snapped)
    scores = settle(scores)
    winner = E.finalists(scores).select("recipe").first()["recipe"]
    recipe, calibrator = winner.rsplit("__", 1)
    parts = recipes[recipe]
    names = list(parts)

    # refit on training and validation rows together
    columns = [key, vector, y, group, source]
    development = with_folds(train.select(*columns).unionByName(val.select(*columns)), key, strata, folds, seed + 1009)
    components = [by_name[n] for n in names]
    again, failed = L.out_of_fold(development, keep, vector, y, group, "fold", width, components)
    if failed:
        raise RuntimeError(f"selected components failed on the development rows: {failed}")
    again = settle(again.select(*plain))
    if sum(w > 1e-9 for w in parts.values()) > 1:
        both = settle(E.wide(again, key, "candidate", "pred", names, ("y", "g")))
        parts = E.convex_weights(both, names, "y", "g", prior=[parts[n] for n in names], penalty=0.05)
    ids = [key, "source", "g", "y"]
    base = settle(E.blend(again, ids, "candidate", "pred", {"final": parts}))
    parameters = C.fit(base, calibrator)

    # the test rows, once
    tested = L.refit_predict(development, test, keep, vector, y, group, "fold", width, components).select(*plain)
    blended = settle(E.blend(tested, ids, "candidate", "pred", {"final": parts}))
    final = settle(C.apply(blended, parameters, calibrator, snapped=snapped).select(*ids, F.col("calibrated").alias("pred")))
    slices = slices or {"source": F.col("source"), "group": F.col("g")}
    return Experiment(
        metrics, failures, shortlist, weights, scores, recipe, calibrator, parts,
        regression_metrics(scored.where(F.col("recipe") == winner), [], "y", "pred"), final, regression_metrics(final, [], "y", "pred"),
        bootstrap_ci(final, key, "y", "pred", seed=seed + 2027, repetitions=repetitions), sliced_metrics(final, slices, "y", "pred"),
    )


def report(result: Experiment) -> DataFrame:
    """The experiment as rows (part, name, measure, value)."""
    spark = result.test.sparkSession
    said = [("shortlist", n, "place", float(i + 1)) for i, n in enumerate(result.shortlist)]
    said += [("oof_weight", n, "weight", w) for n, w in result.oof_weights.items()]
    said += [("final_weight", n, "weight", w) for n, w in result.weights.items()]
    said += [("failure", f"{n}: {m}", "failed", 1.0) for n, m in result.failures.items()]
    said += [("frozen", f"{result.recipe}__{result.calibrator}", "chosen", 1.0)]
    out = spark.createDataFrame(said, "part string, name string, measure string, value double")

    def long(df: DataFrame, part: str, name: Column) -> DataFrame:
        numbers = [c for c, t in df.dtypes if t in ("double", "bigint", "int")]
        pairs = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in numbers])
        return df.select(F.lit(part).alias("part"), name.alias("name"), F.explode(pairs).alias("_p")).select("part", "name", "_p.*")

    tables = (
        (result.candidate_metrics, "candidate", F.col("candidate")), (result.recipe_metrics, "recipe", F.col("recipe")),
        (result.validation, "validation", F.lit("all")), (result.test_metrics, "test", F.lit("all")), (result.test_interval, "interval", F.lit("all")),
        (result.test_slices, "slice", F.concat_ws("=", "slice_dim", "slice_value")),
    )
    for df, part, name in tables:
        out = out.unionByName(long(df, part, name))
    return out
