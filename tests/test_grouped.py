"""The paths for huge groups and large tables give what the plain paths give."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rollcall.operators import grouped as G


def frame(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    # one key holds a third of the rows; ties and missing values included
    key = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 12, n))
    value = np.round(rng.normal(170, 9, n), 1)
    pdf = pd.DataFrame({"id": np.arange(n), "k": key, "v": value})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.col("id") % 17 != 0, F.col("v")))
    return df, pdf[pdf.id % 17 != 0], pdf


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("lower", [False, True])
def test_quantiles(spark, monkeypatch, keys, lower):
    df, valid, _ = frame(spark)
    probs = {"a": 0.1, "b": 0.5, "c": 0.9}
    plain = G.group_quantiles(df, keys, "v", probs, lower, aggs={"n": F.count(F.lit(1))})
    expected = rows(plain, *keys)
    monkeypatch.setattr(G, "GROUP_ROWS", 5)
    monkeypatch.setattr(G, "BROADCAST_ROWS", 2)
    sliced = rows(G.group_quantiles(df, keys, "v", probs, lower, aggs={"n": F.count(F.lit(1))}).select(plain.columns), *keys)
    assert np.allclose(np.array(sliced, float), np.array(expected, float))
    method = "inverted_cdf" if lower else "linear"
    groups = valid.groupby("k").v if keys else [(None, valid.v)]
    brute = [[np.quantile(v, p, method=method) for p in probs.values()] for _, v in groups]
    assert np.allclose([r[len(keys) : len(keys) + 3] for r in expected], brute)


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_and_positions(spark, tight, keys):
    df, _, pdf = frame(spark)
    out = G.running(df, keys, ["v", "id"], {"s": ("sum", F.col("id")), "m": ("min", F.col("v")), "x": ("max", F.col("id"))})
    got = pd.DataFrame(rows(out.select("id", "s", "m", "x"), "id"), columns=["id", "s", "m", "x"])
    pdf = pdf.assign(v=pdf.v.where(pdf.id % 17 != 0))
    # NULLs sort first in Spark
    pdf = pdf.assign(_o=pdf.v.fillna(-1)).sort_values(["_o", "id"])
    group = pdf.groupby("k") if keys else pdf.groupby(lambda _: 0)
    want = pd.DataFrame({"id": pdf.id, "s": group.id.cumsum(), "m": group.v.cummin(), "x": group.id.cummax()}).sort_values("id")
    want["m"] = want["m"].where(want["m"].notna(), None)
    assert got.s.tolist() == want.s.tolist() and got.x.tolist() == want.x.tolist()
    places = G.positions(df, keys, ["v", "id"], "p")
    got = {r["id"]: r["p"] for r in places.collect()}
    assert got == dict(zip(pdf.id, group.cumcount() + 1))


def test_lookup_join_slices_hot_groups(spark, tight):
    df, _, pdf = frame(spark)
    table = spark.createDataFrame([(i, i * 10) for i in range(9)], "k long, w long")
    out = G.lookup_join(df, table, ["k"])
    got = {r["id"]: r["w"] for r in out.collect()}
    assert len(got) == len(pdf) == out.count()
    assert got == {i: (k * 10 if k < 9 else None) for i, k in zip(pdf.id, pdf.k)}
    assert G.lookup_join(df, table, ["k"], how="inner").count() == int((pdf.k < 9).sum())


def test_lookup_join_matches_null_keys(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "id int, k string")
    table = spark.createDataFrame([(None, 5), ("a", 6)], "k string, w int")
    assert {r["id"]: r["w"] for r in G.lookup_join(df, table, ["k"]).collect()} == {1: 5, 2: 6}


def test_attach(spark, monkeypatch):
    df, _, _ = frame(spark)
    aggs = {"n": F.count(F.lit(1)), "m": F.max("v")}
    plain = rows(G.attach(df, ["k"], aggs), "id")
    monkeypatch.setattr(G, "GROUP_ROWS", 5)
    assert rows(G.attach(df, ["k"], aggs).select("id", "k", "v", "n", "m"), "id") == plain


def test_partitioning_does_not_matter(spark):
    df, _, _ = frame(spark)
    results = set()
    for other in (df.repartition(1), df.repartition(17), df.orderBy(F.rand(3))):
        out = G.group_quantiles(other, ["k"], "v", {"m": 0.5})
        results.add(str(rows(out, "k")))
    assert len(results) == 1


def test_empty_and_all_null(spark):
    empty = spark.createDataFrame([], "k int, v double")
    assert G.group_quantiles(empty, ["k"], "v", {"m": 0.5}).count() == 0
    nulls = spark.createDataFrame([(1, None), (1, None)], "k int, v double")
    assert G.group_quantiles(nulls, ["k"], "v", {"m": 0.5}).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_running_sums_with_missing_values(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(G, "GROUP_ROWS", 2)
        monkeypatch.setattr(G, "SLICE_ROWS", 5)
    values = [None, None, 1.0, None, 2.0, None, None, None, 4.0, None] * 4
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double")
    got = [r["s"] for r in G.running(df, [], ["id"], {"s": ("sum", F.col("v"))}).orderBy("id").collect()]
    want, total = [], None
    for v in values:
        total = total if v is None else (total or 0.0) + v
        want.append(total)
    assert got == want


def test_one_key_with_a_third_of_the_rows_and_equal_copies(spark, tight):
    df = spark.createDataFrame([(0, "same")] * 40 + [(i, "x") for i in range(1, 81)], "k long, v string")
    table = spark.createDataFrame([(i, i) for i in range(81)], "k long, w long")
    out = G.lookup_join(df, table, ["k"], "inner")
    assert out.count() == 120 and out.filter("k = 0 AND w = 0").count() == 40


def test_frames_keep_a_short_last_frame(spark):
    from rollcall.functions.arrays import frames_of

    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1.0] * 8,), ([],), (None,)], "v array<double>")
    got = [r["f"] for r in df.select(frames_of(F.col("v"), 4).alias("f")).collect()]
    assert got == [[[1.0, 2.0, 3.0]], [[1.0] * 4, [1.0] * 4], [], None]


def test_a_chain_of_steps_measures_its_groups_once(spark, tight, monkeypatch):
    from rollcall.operators import pooling

    df, _, _ = frame(spark)
    calls = []
    measure = G.largest_group
    monkeypatch.setattr(G, "largest_group", lambda d, keys: calls.append(tuple(keys)) or measure(d, keys))
    rows = df.withColumn("q", F.lit(1.0))
    sliced = pooling.pool_robust(rows, "k", "v", F.col("q"))
    assert calls.count(("k",)) == 1
    monkeypatch.setattr(G, "GROUP_ROWS", 10**6)
    plain = pooling.pool_robust(rows, "k", "v", F.col("q"))
    a, b = (sorted(tuple(r) for r in d.select("k", "mean", "var", "surviving", "rejected").collect()) for d in (sliced, plain))
    assert np.allclose(np.array(a, float), np.array(b, float))


@pytest.mark.parametrize("buckets", [1, 7, 4096])
@pytest.mark.parametrize("lower", [False, True])
def test_quantiles_of_wide_spans(spark, monkeypatch, buckets, lower):
    rng = np.random.default_rng(2)
    odd = [0.0, -0.0, 1e308, -1e308, 5e-324, float("inf"), float("-inf"), float("nan")]
    values = [(0, float(v)) for v in rng.normal(size=300)] + [(1, 3.0)] * 50 + [(2, v) for v in odd * 4] + [(None, 1.0), (None, 2.0), (3, None)]
    values += [(4, float(10.0**v)) for v in rng.integers(-200, 200, 200)] + [(5, float("inf"))] * 9
    df = spark.createDataFrame(values, "k int, v double")
    probs = {"a": 0.0, "b": 0.33, "c": 0.5, "d": 1.0}
    plain = G.group_quantiles(df, ["k"], "v", probs, lower, aggs={"n": F.count(F.lit(1))})
    expected = rows(plain, "k")
    monkeypatch.setattr(G, "GROUP_ROWS", 5)
    monkeypatch.setattr(G, "BUCKETS", buckets)
    calls = []
    near = G._near_quantiles
    monkeypatch.setattr(G, "_near_quantiles", lambda *a: calls.append(1) or near(*a))
    sliced = rows(G.group_quantiles(df, ["k"], "v", probs, lower, aggs={"n": F.count(F.lit(1))}).select(plain.columns), "k")
    # interpolation between infinities is not compared
    finite = lambda table: [r for r in table if r[0] not in (2, 5)]
    assert calls and [r[0] for r in sliced] == [r[0] for r in expected]
    assert np.allclose(np.array(finite(sliced), float), np.array(finite(expected), float), equal_nan=True)
