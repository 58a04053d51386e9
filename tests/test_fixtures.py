"""Hand-computed cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.functions import arrays as A
from rollcall.functions import labels as L
from rollcall.functions import numbers as N
from rollcall.functions import quality as Q
from rollcall.operators import audit, calibrate, gates, metrics, pooling, profile, rules, sampling, windows
from rollcall.operators.frames import repair_frames


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_units_and_dates(spark):
    r = one(
        spark, N.imperial_to_cm(F.lit("5'11\"")), N.imperial_to_cm(F.lit("tall")), N.imperial_to_cm(F.lit("6")),
        N.cm_to_feet_inches(F.lit(180.34)), N.derive_age(F.lit("03/03/86"), F.lit("06/17/60")), N.derive_age(F.lit("x"), F.lit("06/17/60")),
    )
    assert tuple(r) == (180.34, None, 182.88, "5'11.0\"", 25, None)


def test_numbers_never_keep_nan(spark):
    r = one(spark, *[N.safe_number(F.lit(t)) for t in ("nan", "inf", " 2.5 ", "1,5", "")], N.safe_number(F.lit("1,500"), True))
    assert tuple(r) == (None, None, 2.5, None, None, 1500.0)


def test_bin_edges(spark):
    values = (159.99, 160.0, 174.99, 175.0, None)
    r = one(spark, *[N.target_bin(F.lit(v).cast("double")) for v in values])
    assert tuple(r) == ("short", "medium", "medium", "tall", "unknown")
    r = one(spark, *[N.subgroup_label(F.lit(v), F.lit("Male")) for v in (159.0, 175.0, 175.1)])
    assert tuple(r) == ("Short Male (< 160 cm)", "Medium Male (160 - 175 cm)", "Tall Male (> 175 cm)")


def test_lists_keep_first_seen_order(spark):
    r = one(spark, L.join_list(L.split_list(F.lit(" b | a||b|c "), distinct=True)), F.size(L.split_list(F.lit(None).cast("string"))))
    assert tuple(r) == ("b|a|c", 0)


def test_moved_root_paths(spark):
    a = F.lit("/old/root/data/splits/train.csv")
    r = one(spark, L.same_path_suffix(a, F.lit("D:\\new\\data\\splits\\train.csv")), L.same_path_suffix(a, F.lit("/new/data/other/train.csv")), L.same_path_suffix(a, F.lit("")))
    assert tuple(r) == (True, False, False)


def test_array_repair(spark):
    frames = F.array(*[F.array(*[F.lit(float(v)) for v in f]) for f in ((1, 9, 7), (1000, 9, 7), (-5, 9, 7))], F.array(F.lit(float("nan")), F.lit(9.0), F.lit(7.0)))
    df = spark.range(1).select(frames.alias("frames"))
    out = repair_frames(df, "frames", 0, 1, "v1").select(A.column_of(F.col("frames"), 1).alias("x"), "invalid_target_rate", "value_median").first()
    assert out["x"] == [35.0, 17.0, 0.0, 0.0]
    assert out["invalid_target_rate"] == 0.5 and out["value_median"] == 26.0


def test_spacing(spark):
    r = one(spark, A.spacing_summary(F.array(*[F.lit(float(v)) for v in (500, 1500, 2500, 3500)])), A.spacing_summary(F.array(F.lit(500.0))))
    assert 14 <= r["c0"]["length"] <= 18 and 950 <= r["c0"]["spacing"] <= 1100 and 90 <= r["c0"]["estimate"] <= 120
    assert tuple(r["c1"]) == (15.5, 1129.0, 103.85)


def test_quality_gate_cases(spark):
    def gate(values, ok, strict):
        a, why, w = Q.quality_gate(*[F.lit(v) for v in values], F.lit(ok), Q.GatePolicy(strict=strict))
        return tuple(one(spark, a, why, w))

    accepted, why, weight = gate((0.82, 0.88, 18.0, 17.0, 0.005), True, True)
    assert accepted and why == [] and 0.7 <= weight <= 1
    accepted, why, _ = gate((0.30, 0.30, 4.0, 55.0, 0.09), False, True)
    assert not accepted and {"low_capture_quality", "low_snr", "far_microphone"} <= set(why)
    accepted, why, weight = gate((0.35, 0.40, 7.0, 42.0, 0.02), False, False)
    assert accepted and why and 0.05 <= weight < 0.35


def test_reliability_orders_items(spark):
    names = ("capture", "speech", "snr", "clipped", "distance", "voiced", "duration", "drift", "frames", "std")
    good = dict(zip(names, (0.9, 0.8, 22.0, 0.0, 18.0, 0.85, 4.0, 0.2, 96.0, 1.0)))
    bad = dict(zip(names, (0.4, 0.3, 4.0, 0.10, 50.0, 0.1, 0.5, 5.0, 24.0, 6.0)))
    score = lambda d: Q.reliability({**{k: F.lit(v) for k, v in d.items()}, "ood": F.lit(None).cast("double")}, 96.0)
    a, b, c = tuple(one(spark, score(good), score(bad), score({**good, "drift": None})))
    assert 0.05 <= b < a <= 1
    assert c > a  # unknown drift counts as none


def test_robust_pool_rejects_the_outlier(spark):
    df = spark.createDataFrame([("e", 170.0, 0.9), ("e", 171.0, 0.8), ("e", 209.0, 0.9)], "e string, v double, r double")
    out = pooling.pool_robust(df, "e", "v", F.col("r"), F.lit(1.0), min_survivors=2).first()
    assert abs(out["mean"] - 170.5) < 1.5 and out["rejected"] >= 1 and out["surviving"] >= 2


@pytest.mark.parametrize("method", pooling.METHODS)
def test_pooling_paths_agree(spark, monkeypatch, method):
    from rollcall.operators import grouped

    rng = np.random.default_rng(1)
    rows = [(int(k), float(v), float(q), float(s)) for k, v, q, s in zip(rng.integers(0, 6, 200), rng.normal(170, 8, 200), rng.random(200) + 0.05, rng.random(200) * 9 + 1)]
    df = spark.createDataFrame(rows, "e int, v double, q double, s double")
    run = lambda: {r["e"]: (round(r["mean"], 9), round(r["var"], 9)) for r in pooling.pool(df, method, "e", "v", F.col("q"), F.col("s")).collect()}
    plain = run()
    monkeypatch.setattr(grouped, "GROUP_ROWS", 4)
    monkeypatch.setattr(grouped, "BROADCAST_ROWS", 1)
    assert run() == plain and len(plain) == 6


def test_unknown_method_is_an_error(spark):
    df = spark.createDataFrame([("e", 1.0)], "e string, v double")
    with pytest.raises(ValueError, match="unknown pooling"):
        pooling.pool(df, "nope", "e", "v", F.lit(1.0), F.lit(1.0))
    with pytest.raises(ValueError, match="unknown calibrator"):
        calibrate.fit(df, "nope")


def test_snap_is_half_even_on_the_grid(spark):
    assert tuple(one(spark, calibrate.snap(F.lit(170.10)))) == (pytest.approx(170.18),)
    rows = spark.createDataFrame([("T", 0, 170.10, 170.10), ("N", 0, 170.10, 170.10)], "source string, g int, pred double, y double")
    params = calibrate.fit(rows, "group_snap")
    out = {r["source"]: r["calibrated"] for r in calibrate.apply(rows, params, "group_snap", snapped=("T",)).collect()}
    assert out["T"] == pytest.approx(170.18) and out["N"] == pytest.approx(170.10)


def test_consent_intake(spark):
    columns = "participant_code string, age_years string, height_measurement_1_cm string, height_measurement_2_cm string, collection_role string, consent_audio_research string, consent_model_training string"
    base = ("157.2", "157.6", "development", "yes", "yes")
    df = spark.createDataFrame([("a", "21", *base), ("b", "17", *base), ("c", None, *base), ("d", "30", "157.2", "158.9", "development", "yes", "yes"), ("e", "30", "180", "180", "", "yes", "yes")], columns)
    got = {r["participant_code"]: (r["status"], r["reason"], r["y"]) for r in rules.intake_status(df, 160.0).collect()}
    assert got["a"][0] == "accepted" and got["a"][2] == pytest.approx(157.4)
    assert got["b"][1] == got["c"][1] == "adult_participants_only"
    assert got["d"][1] == "height_measurements_disagree_gt_1cm" and got["e"][0] == "skipped"
    with pytest.raises(ValueError, match="email"):
        rules.require_pseudonymous(df.withColumn("Email ", F.lit("x")))


def test_leakage_and_contract(spark):
    df = spark.createDataFrame([("train", "a"), ("train", "b"), ("val", "c"), ("test", "a")], "split string, id string")
    report = audit.split_leakage(df, "split", {"entity": F.col("id")})
    got = {r["pair"]: (r["shared"], r["examples"]) for r in report.collect()}
    assert got == {"train_val": (0, ""), "train_test": (1, "a"), "val_test": (0, "")}
    with pytest.raises(ValueError, match="train_test"):
        audit.require_no_leakage(report)
    want = spark.createDataFrame([("train", "p", "h1"), ("val", "q", "h2")], "split string, path string, sha256 string")
    have = spark.createDataFrame([("train", "p", "hX"), ("val", "q", "h2")], "split string, path string, sha256 string")
    assert [tuple(r) for r in audit.contract_violations(want, have, ["split"]).collect()] == [("train", "sha256", "h1", "hX")]
    assert audit.contract_violations(want, want, ["split"]).isEmpty()


def test_prediction_metrics(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 2.0), (2.0, 1.0)], "pred double, y double")
    out = metrics.regression_metrics(df, [], "y", "pred").first()
    assert out["mae"] == pytest.approx(2 / 3) and out["n"] == 3 and out["median_ae"] == 1.0


def test_ks_handles_ties(spark):
    df = spark.createDataFrame([("train", 5.0), ("train", 5.0), ("val", 5.0), ("test", 6.0)], "split string, v double").withColumn("m", F.lit("x"))
    got = {r["pair"]: r["d"] for r in profile.ks(df, ["m"], "v", "split", [("train", "val"), ("train", "test")]).collect()}
    assert got == {"train_val": 0.0, "train_test": 1.0}


def test_multi_seed(spark):
    df = spark.createDataFrame([("x", 1, "val", 2.4), ("x", 2, "val", 2.8), ("x", 1, "test", 2.6), ("x", 2, "test", 2.7), ("y", 1, "val", 3.0)], "v string, seed int, m string, value double")
    got = {(r["v"], r["m"]): (r["n_runs"], round(r["mean"], 6), round(r["std"], 6)) for r in metrics.multi_seed(df, "v", "seed", "m", "value").collect()}
    assert got[("x", "val")] == (2, 2.6, 0.2) and got[("x", "test")][1] == 2.65 and got[("y", "val")] == (1, 3.0, 0.0)


def test_folds_hold_everyone_out_once(spark):
    df = spark.range(40).withColumn("s", (F.col("id") % 4).cast("string"))
    a = {r["id"]: r["fold"] for r in sampling.stratified_folds(df, "id", [F.col("s")], 5, 3).collect()}
    b = {r["id"]: r["fold"] for r in sampling.stratified_folds(df.repartition(7), "id", [F.col("s")], 5, 3).collect()}
    assert a == b and len(a) == 40
    assert all(sorted(a.values()).count(f) == 8 for f in range(5))
    with pytest.raises(ValueError):
        sampling.stratified_folds(spark.range(3), "id", [F.col("id").cast("string")], 5, 3)


def test_split_gives_exact_source_totals(spark, tight):
    df = spark.range(103).select("id", F.lit("s").alias("source"), (F.col("id") % 7).cast("string").alias("stratum"))
    out = sampling.stratified_split(df, "id", ["source"], "stratum", {"train": 0.7, "val": 0.15, "test": 0.15}, 1)
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"train": 72, "val": 15, "test": 16} and out.select("id").distinct().count() == 103


def test_moving_error_equals_the_loop(spark):
    errors = [3.0, 5.0, 1.0, 4.0, 2.0]
    df = spark.createDataFrame([("b", i, e) for i, e in enumerate(errors)], "bin string, step int, e double")
    out = windows.moving_error(df, ["bin"], ["step"], "e", 0.9).first()["moving_error"]
    state = errors[0]
    for e in errors[1:]:
        state = 0.9 * state + 0.1 * e
    assert math.isclose(out, state)


def test_gates(spark):
    df = spark.createDataFrame([("a", 5.0, 4.0, 5.0, 4.5, 0.1), ("b", 5.0, 4.95, 5.0, 4.5, 0.1), ("c", None, 4.0, 5.0, 4.5, 0.1), ("d", 5.0, 4.0, 5.0, 4.5, 0.5)], "s string, ov double, nv double, ot double, nt double, w double")
    got = {r["s"]: r["decision"] for r in gates.promotion(df, "ov", "nv", "ot", "nt", "w").collect()}
    assert got == {"a": "promote", "b": "kill", "c": "hold", "d": "kill"}


def test_missing_variance_has_no_vote(spark):
    df = spark.createDataFrame([("e", 100.0, 1.0), ("e", 200.0, None)], "e string, v double, s double")
    assert pooling.pool_inverse_variance(df, "e", "v", F.lit(1.0), F.col("s")).first()["mean"] == 100.0


def test_evidence_without_quality_or_variance(spark):
    rows = [(1, 170.0, 4.0, 0.0), (1, 171.0, 4.0, 0.0), (2, 170.0, 4.0, 1.0), (2, 171.0, 4.0, 0.0), (3, 170.0, 0.0, 1.0), (3, 170.5, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "e int, v double, var double, q double")
    out = {r["e"]: r for r in pooling.pool_evidence(df, ["e"], "v", "var", F.col("q")).collect()}
    assert np.isnan(out[1]["mean"]) and out[1]["std"] == pytest.approx(np.sqrt(3.0)) and out[1]["status"] == "SUCCESS"
    assert out[2]["mean"] == pytest.approx(170.0) and out[2]["n_accepted"] == 2
    assert out[3]["mean"] == pytest.approx(170.25) and out[3]["std"] == 0.0
