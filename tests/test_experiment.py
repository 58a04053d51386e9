"""The frozen experiment: what the test rows may and may not change, and what the refit predicts."""

import numpy as np

from rollcall.operators import experiment as X
from rollcall.operators import linear as L

CANDIDATES = (L.Candidate("ridge__a", alpha=1.0), L.Candidate("ridge__b", k=2, alpha=30.0), L.Candidate("pca__1", "pca", 1, 1.0))


def rows(spark, shift=0.0):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 4))
    y = 165.0 + x @ np.array([4.0, -3.0, 2.0, 0.5]) + rng.normal(size=120) * 2.0
    data = []
    for i in range(120):
        split = "train" if i < 60 else "val" if i < 90 else "test"
        data.append((i, x[i].tolist(), float(y[i]) + (shift if split == "test" else 0.0), i % 2, f"s{i % 4 // 2}", split))
    return x, y, spark.createDataFrame(data, "id long, v array<double>, y double, g int, source string, split string")


def run(spark, shift=0.0):
    x, y, df = rows(spark, shift)
    train, val, test = (df.where(f"split = '{s}'").drop("split") for s in ("train", "val", "test"))
    return x, y, X.frozen_experiment(train, val, test, CANDIDATES, 4, key="id", folds=3, kinds=("raw", "global"), repetitions=50)


def test_the_test_rows_are_looked_at_once(spark):
    x, y, one = run(spark)
    _, _, two = run(spark, 40.0)
    assert (one.shortlist, one.recipe, one.calibrator, one.weights) == (two.shortlist, two.recipe, two.calibrator, two.weights)
    preds = {r["id"]: r["pred"] for r in one.test.collect()}
    again = {r["id"]: r["pred"] for r in two.test.collect()}
    assert sorted(preds) == list(range(90, 120))
    assert all(abs(preds[i] - again[i]) < 1e-6 for i in preds)
    assert abs(sum(one.weights.values()) - 1.0) < 1e-9
    mae = float(np.mean([abs(preds[i] - y[i]) for i in preds]))
    found = one.test_metrics.first()
    assert abs(found["mae"] - mae) < 1e-9 and mae < 3.0
    assert two.test_metrics.first()["mae"] > 30.0
    low, high = one.test_interval.select("lower_95", "upper_95").first()
    assert low < mae < high
    parts = {r["part"] for r in X.report(one).select("part").distinct().collect()}
    assert parts >= {"shortlist", "final_weight", "candidate", "recipe", "validation", "test", "interval", "slice", "frozen"}
