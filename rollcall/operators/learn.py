"""Models on entity vectors: Spark ML estimators and ridge grids from Gram matrices."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.operators.grouped import group_quantiles
from rollcall.operators.profile import unpivot
from rollcall.session import settle


def impute_scale(
    df: DataFrame, columns: Sequence[str], robust: bool = False, train: DataFrame | None = None, suffix: str = "_scaled"
) -> DataFrame:
    """Median imputation with missing flags, then standard or robust (10-90 %) scaling.

    Everything is fitted on ``train`` (default: the rows themselves).  Standard
    scaling uses the population sd of the imputed values; a constant column is
    only centred.
    """
    base = train if train is not None else df
    known = base.count()
    medians = group_quantiles(unpivot(base, [], columns), ["metric"], "value", {"m": 0.5}, known=known * len(columns))
    row = medians.agg(*[F.max(F.when(F.col("metric") == c, F.col("m"))).alias(c) for c in columns])
    fill = row.select(F.struct(*columns)).scalar()
    impute = lambda d: d.withColumn("_fill", fill).select(
        *[c for c in d.columns], *[F.coalesce(F.col(c), F.col(f"_fill.{c}")).alias(f"_i_{c}") for c in columns]
    )
    filled = impute(base)
    imputed = [f"_i_{c}" for c in columns]
    if robust:
        spread = group_quantiles(
            unpivot(filled, [], imputed), ["metric"], "value", {"c": 0.5, "lo": 0.1, "hi": 0.9}, known=known * len(columns)
        ).withColumn("s", F.col("hi") - F.col("lo"))
    else:
        spread = unpivot(filled, [], imputed).groupBy("metric").agg(F.avg("value").alias("c"), F.stddev_pop("value").alias("s"))
    picks = [
        F.max(F.when(F.col("metric") == f"_i_{c}", F.struct("c", "s"))).alias(c) for c in columns
    ]
    scale = spread.agg(*picks)
    rows = impute(df).withColumn("_scale", scale.select(F.struct(*columns)).scalar())
    out = {}
    for c in columns:
        centred = F.col(f"_i_{c}") - F.col(f"_scale.{c}.c")
        width = F.col(f"_scale.{c}.s")
        out[f"{c}{suffix}"] = F.when(width > 1e-12, centred / width).otherwise(centred)
        out[f"{c}_missing"] = F.col(c).isNull().cast("int")
    return rows.withColumns(out).drop("_scale", *imputed)


def pca_whitened(df: DataFrame, vector: str, k: int, train: DataFrame | None = None, out: str = "components") -> DataFrame:
    """First k principal components, each with unit variance over the training rows."""
    prepare = lambda d: d.withColumn("_vec", array_to_vector(F.col(vector)))
    fitted_on = prepare(train if train is not None else df)
    model = Pipeline(
        stages=[
            StandardScaler(inputCol="_vec", outputCol="_centred", withMean=True, withStd=False),
            PCA(k=k, inputCol="_centred", outputCol="_pc"),
            StandardScaler(inputCol="_pc", outputCol="_white", withMean=False, withStd=True),
        ]
    ).fit(fitted_on)
    return model.transform(prepare(df)).withColumn(out, vector_to_array("_white")).drop("_vec", "_centred", "_pc", "_white")


def gram_sums(df: DataFrame, vector: str, y: str, weight: str, keys: Sequence[str], width: int) -> DataFrame:
    """Weighted sufficient statistics per group: the upper triangle of [1 x y]' W [1 x y].

    A task reduces every Arrow batch to one small matrix per group, so what is
    shuffled is groups x tasks x width^2 / 2 numbers, whatever the row count.
    """
    size = width + 2
    upper = np.triu_indices(size)
    types = dict(df.dtypes)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for group, part in batch.groupby(list(keys), sort=False):
                z = np.column_stack([np.ones(len(part)), np.stack(part[vector].to_numpy()), part[y].to_numpy(float)])
                gram = (z * part[weight].to_numpy(float)[:, None]).T @ z
                sums[group] = sums.get(group, 0.0) + gram[upper]
        for group, cells in sums.items():
            out = pd.DataFrame({"cell": np.arange(len(cells)), "total": cells})
            for name, value in zip(keys, group):
                out[name] = value
            yield out[[*keys, "cell", "total"]]

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", cell int, total double"
    return df.select(*keys, vector, y, weight).mapInPandas(partial, schema).groupBy(*keys, "cell").agg(F.sum("total").alias("total"))


def collect_grams(sums: DataFrame, keys: Sequence[str], width: int) -> dict[tuple, np.ndarray]:
    """Full matrices per group; their number and size do not depend on the rows."""
    size = width + 2
    upper = np.triu_indices(size)
    pdf = sums.toPandas()
    out = {}
    for group, part in pdf.groupby(list(keys)):
        matrix = np.zeros((size, size))
        cells = part.sort_values("cell")["total"].to_numpy()
        matrix[upper] = cells
        out[group] = matrix + np.triu(matrix, 1).T
    return out


def solve_ridge(gram: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """(intercept, coefficients on raw columns) of ridge on standardised columns."""
    n = gram[0, 0]
    mean, y_mean = gram[0, 1:-1] / n, gram[0, -1] / n
    cov = gram[1:-1, 1:-1] - n * np.outer(mean, mean)
    xy = gram[1:-1, -1] - n * mean * y_mean
    std = np.sqrt(np.maximum(np.diag(cov) / n, 0.0))
    std = np.where(std > 1e-12, std, 1.0)
    beta = np.linalg.solve(cov / np.outer(std, std) + alpha * np.eye(len(std)), xy / std) / std
    return float(y_mean - mean @ beta), beta


def linear_prediction(vector: Column, intercept: float, beta: np.ndarray) -> Column:
    weights = F.array(*[F.lit(float(b)) for b in beta])
    return F.aggregate(F.zip_with(vector, weights, lambda a, b: a * b), F.lit(float(intercept)), lambda a, x: a + x)


def ridge_grid(
    df: DataFrame, key: str, vector: str, y: str, fold: str, width: int, alphas: Sequence[float],
    external: DataFrame | None = None, external_weights: Sequence[float] = (),
) -> DataFrame:
    """Out-of-fold ridge predictions (key, y, fold, candidate, pred) for a whole grid.

    One pass gives a Gram matrix per fold; the training matrix of a fold is the
    total minus its own, and every alpha and external weight is solved from it.
    External rows (never held out) add their matrix times the weight.
    """
    one = df.withColumn("_w", F.lit(1.0))
    grams = collect_grams(gram_sums(one, vector, y, "_w", [fold], width), [fold], width)
    total = sum(grams.values())
    extra = None
    if external is not None:
        marked = external.withColumns({"_w": F.lit(1.0), fold: F.lit(-1)})
        extra = collect_grams(gram_sums(marked, vector, y, "_w", [fold], width), [fold], width)[(-1,)]
    grid = [(a, 0.0) for a in alphas] + [(a, w) for a in alphas for w in (external_weights if extra is not None else ())]
    labels, tables = [], []
    for alpha, w in grid:
        labels.append(f"ridge_a{alpha:g}_" + (f"external_w{w:g}" if w else "target_only"))
        per = {}
        for (f,), own in grams.items():
            train = total - own + (w * extra if w else 0.0)
            per[f] = solve_ridge(train, alpha)
        tables.append(per)
    folds = sorted(f for (f,) in grams)
    coefficients = {f: np.stack([np.concatenate([[t[f][0]], t[f][1]]) for t in tables]) for f in folds}
    types = dict(df.dtypes)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f, part in batch.groupby(fold, sort=False):
                z = np.column_stack([np.ones(len(part)), np.stack(part[vector].to_numpy())])
                out = z @ coefficients[f].T
                yield pd.DataFrame(
                    {key: np.repeat(part[key].to_numpy(), len(labels)), y: np.repeat(part[y].to_numpy(float), len(labels)),
                     fold: f, "candidate": np.tile(labels, len(part)), "pred": out.ravel()}
                )

    schema = f"{key} {types[key]}, {y} double, {fold} {types[fold]}, candidate string, pred double"
    return df.select(key, vector, y, fold).mapInPandas(predict, schema)


def regressors(seed: int = 11) -> dict[str, object]:
    """Candidate estimators on a ``features`` vector with label ``y`` and weight ``w``."""
    common = {"featuresCol": "features", "labelCol": "y", "predictionCol": "pred"}
    return {
        "ridge": LinearRegression(**common, regParam=0.1, elasticNetParam=0.0, weightCol="w"),
        "huber": LinearRegression(**common, loss="huber", epsilon=1.35, regParam=0.001, maxIter=1000, weightCol="w"),
        "elastic": LinearRegression(**common, regParam=0.05, elasticNetParam=0.3, weightCol="w"),
        "forest": RandomForestRegressor(**common, numTrees=20, maxDepth=5, seed=seed, weightCol="w"),
        "boosted": GBTRegressor(**common, lossType="absolute", maxIter=8, maxDepth=3, seed=seed, weightCol="w"),
    }


def oof_predictions(df: DataFrame, key: str, fold: str, estimators: Mapping[str, object]) -> tuple[DataFrame, dict[str, str]]:
    """(long out-of-fold predictions, failures): one fit per candidate and fold.

    A candidate that its data or parameters make fail is recorded, and the others go on; any
    other error, such as a lost cluster, ends the call.
    """
    data = settle(df)
    folds = [r[fold] for r in data.select(fold).distinct().orderBy(fold).collect()]
    out, failures = None, {}
    for name, estimator in estimators.items():
        try:
            parts = None
            for f in folds:
                model = estimator.fit(data.filter(F.col(fold) != f))
                part = model.transform(data.filter(F.col(fold) == f)).select(key, "y", fold, F.lit(name).alias("candidate"), "pred")
                parts = part if parts is None else parts.unionByName(part)
            parts = settle(parts)
            bad = parts.filter(F.col("pred").isNull() | F.isnan("pred") | (F.abs("pred") == float("inf"))).count()
            if bad:
                raise ValueError(f"{bad} unusable predictions")
        except (AnalysisException, IllegalArgumentException, ValueError) as exc:
            failures[name] = f"{type(exc).__name__}: {exc}"
            continue
        out = parts if out is None else out.unionByName(parts)
    if out is None:
        raise RuntimeError(f"every candidate failed: {failures}")
    return out, failures


def fit_predict(train: DataFrame, query: DataFrame, key: str, estimators: Mapping[str, object], names: Sequence[str]) -> DataFrame:
    """Refit the chosen candidates on all training rows and predict the query rows."""
    data = settle(train)
    out = None
    for name in names:
        part = estimators[name].fit(data).transform(query).select(key, F.lit(name).alias("candidate"), "pred")
        out = part if out is None else out.unionByName(part)
    return out


def save_bundle(models: Mapping[str, PipelineModel], path: str) -> None:
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/{name}")


def score_bundle(
    df: DataFrame, key: str, path: str, weights: Mapping[str, float], slope: float, intercept: float, low: float, high: float, half_width: float
) -> DataFrame:
    """Score rows with the saved models, blend, calibrate, bound, and word the interval.

    A missing input vector is an error, not a zero.
    """
    checked = df.withColumn("features", F.when(F.col("features").isNull(), F.raise_error(F.lit("missing input vector"))).otherwise(F.col("features")))
    total = F.lit(0.0)
    rows = checked
    for name, weight in weights.items():
        model = PipelineModel.load(f"{path}/{name}")
        rows = model.transform(rows).withColumnRenamed("pred", f"_p_{name}")
        total = total + F.col(f"_p_{name}") * F.lit(float(weight))
    bounded = F.least(F.greatest(total * slope + intercept, F.lit(low)), F.lit(high))
    return rows.select(
        key, bounded.alias("pred"),
        F.format_string("%.1f - %.1f", bounded - half_width, bounded + half_width).alias("interval"),
    )


def mean_baseline(train: DataFrame, rows: DataFrame, y: str) -> DataFrame:
    """The training mean as everyone's prediction."""
    return rows.withColumn("pred", train.agg(F.avg(y).alias("m")).select("m").scalar())
