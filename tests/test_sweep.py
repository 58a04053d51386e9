import pytest
from pyspark.sql import functions as F

from rollcall.operators import grouped, sampling

RATIOS = {"train": 0.7, "val": 0.15, "test": 0.15}
SEEDS = range(5, 35)
VALUES = ("y", "age", "none")


def table(spark, n=200):
    odd = {0: float("nan"), 1: float("inf"), 2: -0.0, 3: 0.0, 4: None}
    rows = [(i, [None, "A", "B"][i % 3], "xy"[i % 7 == 0], odd.get(i, float(i * 37 % 101) / 7), float(i % 4), None) for i in range(n)]
    rows.append((None, "A", "x", 1.0, 2.0, None))
    return spark.createDataFrame(rows, "id bigint, source string, stratum string, y double, age double, none double")


def one_by_one(df, seeds):
    out, splits = {}, {}
    for s in seeds:
        labels = sampling.stratified_split(df.withColumn("seed", F.lit(s)), "id", ["seed", "source"], "stratum", RATIOS, "sweep", keep=VALUES).cache()
        out[s] = sampling.split_objective(labels, ["seed"], "source", "split", VALUES, RATIOS).first()
        splits[s] = sorted((str(r["id"]), r["split"]) for r in labels.collect())
    return out, splits


@pytest.mark.parametrize("large", [False, True])
def test_sweep_equals_single_seeds(spark, monkeypatch, large):
    df = table(spark)
    if large:
        monkeypatch.setattr(grouped, "GROUP_ROWS", 20)  # strata that no task may hold
    scores, winner = sampling.seed_sweep(df, "id", "source", "stratum", VALUES, RATIOS, SEEDS)
    got = {r["seed"]: r for r in scores.collect()}
    assert set(got) == set(SEEDS)
    monkeypatch.undo()
    best = min(got, key=lambda s: (got[s]["objective"], s))
    expected, splits = one_by_one(df, {28, best})
    for s, r in expected.items():
        assert [got[s][c] for c in ("avg_ks", "penalty", "objective")] == pytest.approx([r[c] for c in ("avg_ks", "penalty", "objective")], abs=1e-12)
    rows = winner.collect()
    assert {r["seed"] for r in rows} == {best}
    assert sorted((str(r["id"]), r["split"]) for r in rows) == splits[best]


def test_sweep_does_not_repeat_rows_by_seed(spark, monkeypatch):
    counts = []

    def counted(df):
        out = grouped.settle_counted(df)
        counts.append(out[1])
        return out

    monkeypatch.setattr(sampling, "settle_counted", counted)
    monkeypatch.setattr(sampling, "settle", lambda df: counted(df)[0])
    df = table(spark, 600)
    sampling.seed_sweep(df, "id", "source", "stratum", VALUES, RATIOS, SEEDS)
    assert max(counts) < df.count() * len(SEEDS) / 4
