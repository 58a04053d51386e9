"""Grids, weights and intervals against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.operators import ensemble, learn, stats


def vectors(spark, n=60, d=3, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = x @ np.arange(1, d + 1) + rng.normal(size=n) * 0.1 + 5
    rows = [(i, [float(v) for v in x[i]], float(y[i]), i % 4) for i in range(n)]
    return spark.createDataFrame(rows, "id long, v array<double>, y double, fold int"), x, y


def brute_ridge(x, y, w, alpha):
    mean, y_mean = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    std = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=w))
    z = (x - mean) / std
    beta = np.linalg.solve((z * w[:, None]).T @ z + alpha * np.eye(x.shape[1]), (z * w[:, None]).T @ (y - y_mean))
    return lambda q: (q - mean) / std @ beta + y_mean


def test_ridge_grid_equals_refits(spark):
    df, x, y = vectors(spark)
    ext, xe, ye = vectors(spark, n=20, seed=9)
    out = learn.ridge_grid(df.repartition(5), "id", "v", "y", "fold", 3, (0.5, 5.0), ext, (0.3,)).collect()
    assert len(out) == 60 * 4
    got = {(r["candidate"], r["id"]): r["pred"] for r in out}
    folds = np.arange(60) % 4
    for alpha in (0.5, 5.0):
        for f in range(4):
            train, hold = folds != f, np.where(folds == f)[0]
            plain = brute_ridge(x[train], y[train], np.ones(train.sum()), alpha)
            both = brute_ridge(np.vstack([x[train], xe]), np.r_[y[train], ye], np.r_[np.ones(train.sum()), np.full(20, 0.3)], alpha)
            for i in hold:
                assert got[(f"ridge_a{alpha:g}_target_only", i)] == pytest.approx(plain(x[i]))
                assert got[(f"ridge_a{alpha:g}_external_w0.3", i)] == pytest.approx(both(x[i]))


def test_convex_weights_find_the_exact_blend(spark):
    y = [150.0, 160.0, 170.0, 180.0]
    df = spark.createDataFrame([(i, v, v - 2, v + 2) for i, v in enumerate(y)], "id int, y double, a double, b double")
    w = ensemble.convex_weights(df, ("a", "b"), "y", penalty=0.0)
    assert min(w.values()) >= 0 and sum(w.values()) == pytest.approx(1)
    assert np.mean([abs(w["a"] * (v - 2) + w["b"] * (v + 2) - v) for v in y]) < 1e-5


def test_weight_search_is_no_worse_than_any_single(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(170, 8, 80)
    table = np.column_stack([y, y + rng.normal(0, 4, 80), y + rng.normal(0, 4, 80), y + rng.normal(3, 6, 80)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in table], "y double, a double, b double, c double")
    w = ensemble.weight_search(df, ("a", "b", "c"), "y", seed=5, trials=300)
    blend = sum(w.get(n, 0) * table[:, i + 1] for i, n in enumerate("abc"))
    assert sum(w.values()) == pytest.approx(1)
    assert np.abs(blend - y).mean() <= min(np.abs(table[:, i] - y).mean() for i in (1, 2, 3)) + 1e-9


def test_diverse_selection():
    maes = {"ridge__a": 1.0, "ridge__b": 1.1, "tree__c": 1.2, "short_weighted__d": 3.0, "ridge__e": 1.3}
    corr = {(a, b): 0.999 for a in maes for b in maes}
    corr[("ridge__e", "ridge__a")] = corr[("ridge__a", "ridge__e")] = 0.9
    chosen = ensemble.select_diverse(maes, corr, limit=8)
    assert chosen == ["short_weighted__d", "ridge__a", "tree__c", "ridge__e"]


def test_bootstrap_mean_and_width(spark):
    rng = np.random.default_rng(3)
    values = rng.exponential(4.0, 300)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, e double")
    run = lambda d: [r["mean"] for r in stats.bootstrap_means(d, "id", "e", 1, 1500).orderBy("rep").collect()]
    means = run(df)
    assert np.mean(means) == pytest.approx(values.mean(), abs=0.05)
    assert np.std(means) == pytest.approx(values.std() / np.sqrt(300), rel=0.12)
    assert np.allclose(run(df.repartition(7)), means)


def test_paired_bootstrap_sign(spark):
    rows = [(i, 170.0, 170.0 + 3, 170.0 + 1) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, y double, a double, b double")
    out = stats.paired_bootstrap(df, "id", "y", "a", "b", 1, 400).first()
    assert out["mean_delta"] == -2.0 and out["probability_improvement"] == 1.0 and out["upper_95"] == pytest.approx(-2.0)


def test_impute_scale_uses_training_rows_only(spark):
    train = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "id int, x double")
    rows = spark.createDataFrame([(9, None), (10, 5.0)], "id int, x double")
    out = {r["id"]: (r["x_scaled"], r["x_missing"]) for r in learn.impute_scale(rows, ("x",), train=train).collect()}
    assert out[9] == (0.0, 1) and out[10][0] == pytest.approx(3.0 / np.std([1, 2, 3]))


def test_missing_bundle_input_is_an_error(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import array_to_vector

    df, _, _ = vectors(spark)
    ready = df.select("id", "y", F.lit(1.0).alias("w"), array_to_vector("v").alias("features"))
    learn.save_bundle({"ridge": Pipeline(stages=[learn.regressors()["ridge"]]).fit(ready)}, str(tmp_path))
    score = lambda d: learn.score_bundle(d.select("id", "features"), "id", str(tmp_path), {"ridge": 1.0}, 1.0, 0.0, 0.0, 6.0, 1.0)
    assert score(ready).agg(F.max("pred")).first()[0] == 6.0
    broken = ready.withColumn("features", F.when(F.col("id") != 3, F.col("features")))
    with pytest.raises(Exception, match="missing input vector"):
        score(broken).collect()


def test_only_failures_of_a_candidate_are_recorded(spark):
    from pyspark.ml.regression import LinearRegression

    from rollcall.operators import learn

    df = spark.createDataFrame([(i, i % 2, float(i), [float(i), float(i % 3)]) for i in range(20)], "id int, fold int, y double, v array<double>")
    data = df.withColumn("features", learn.array_to_vector("v"))
    plain = LinearRegression(labelCol="y", predictionCol="pred")
    absent = LinearRegression(labelCol="y", featuresCol="nowhere", predictionCol="pred")
    preds, failures = learn.oof_predictions(data, "id", "fold", {"plain": plain, "absent": absent})
    assert preds.count() == 20 and set(failures) == {"absent"}

    class Lost:
        def fit(self, _):
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        learn.oof_predictions(data, "id", "fold", {"lost": Lost()})


def test_draws_invert_the_hash_in_any_span():
    keys = np.array([0, 1, 2, 987_654_321, stats.PRIME - 2, stats.PRIME - 1])
    k, r = keys.astype(object)[:, None], np.arange(700).astype(object)[None, :]
    a = (k * (2 * r + 1) + 12345) % stats.PRIME
    c = ((a * a + r) % stats.PRIME * a + k) % stats.PRIME
    want = np.searchsorted(np.array(stats.POISSON), (c / stats.PRIME).astype(float), side="right")
    assert (stats.draws(keys, 700) == want).all()
    assert (stats.draws(keys, 700, 650) == want[:, 650:]).all()


def test_bootstrap_deals_rows_of_one_partition(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(200)], "id int, e double").coalesce(1)
    sums = stats.replicate_sums(df, "id", "e", 17, 600)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    total = sums.agg(F.sum("weight").alias("w")).first()["w"]
    assert abs(total / (200 * 600) - 1) < 0.02
