"""Sources, sinks, content jobs, streams and plans."""

import hashlib
import json
import math
import os
import pathlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rollcall import schema as SC
from rollcall.operators import jobs
from rollcall.operators.rules import item_rules, with_all_reasons
from rollcall.session import settle_counted, shared_dir
from rollcall.sources import readers, sinks
from rollcall.streaming import jobs as streams
from tests.conftest import SF


def test_checkpoint_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        assert shared_dir(spark) == named
    table, n = settle_counted(spark.range(5).filter("id > 2"))
    assert n == 2 and table.count() == 2
    assert settle_counted(spark.range(5).filter("id > 20"))[1] == 0


def test_manifest_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_bytes("﻿entity_id,source,label,height,weight,age,audio_paths\na,S,Male,170,,30,x|y\n".encode())
    row = readers.read_manifest(spark, str(path)).first()
    assert row["entity_id"] == "a" and row["weight"] is None
    path.write_text("entity_id,source,label,height,weight,age,audio_paths\n")
    with pytest.raises(ValueError, match="no rows"):
        readers.read_manifest(spark, str(path))


def test_listing(spark, tmp_path):
    for name in ("a.wav", "B.WAV", "c.wav", "d.wav", "e.txt"):
        (tmp_path / name).write_text("x")
    assert readers.list_files(spark, str(tmp_path)).count() == 4


def test_manifest_of_files(spark, tmp_path):
    bodies = {"a.bin": b"", "b c%20d.BIN": b"x" * 70_001, "sub/e=1/f.bin": "\u00e4\n".encode() * 5, "g.txt": b"no"}
    for name, body in bodies.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    want = {(n.rsplit("/", 1)[-1], hashlib.sha256(b).hexdigest(), len(b)) for n, b in bodies.items() if b and n != "g.txt"}
    got = sinks.integrity_manifest(spark, str(tmp_path), ".bin", chunk=1000).collect()
    assert {(r["path"].rsplit("/", 1)[-1], r["sha256"], r["bytes"]) for r in got} == want and len(got) == 2


def test_manifest_of_the_given_files(spark):
    want = {(f.name, hashlib.sha256(f.read_bytes()).hexdigest(), f.stat().st_size) for f in pathlib.Path(SF).glob("*.parquet")}
    assert {tuple(r) for r in entry.queries()["sink_integrity_inputs"](spark, SF).collect()} == want and len(want) == 14


def test_levels_and_rules(spark):
    tone = [0.2 * math.sin(2 * math.pi * 220 * i / 800) for i in range(2000)]
    items = [("tone", tone, 800), ("silent", [0.0] * 2000, 800), ("none", [], 800), ("loud", [0.5, -1.0], 0)]
    df = spark.createDataFrame(items, "path string, samples array<double>, rate int").withColumn("channels", F.lit(1))
    found = df.withColumns(jobs.level_stats(F.col("samples"), F.size("samples"), F.col("rate")))
    rules = item_rules(*[F.col(c) for c in ("channels", "rate", "duration", "rms", "peak", "clipping")])
    rows = {r["path"]: r for r in with_all_reasons(found, rules, "why").collect()}
    assert rows["tone"]["duration"] == 2.5 and rows["tone"]["peak"] == pytest.approx(0.2, abs=1e-3)
    assert rows["tone"]["rms"] == pytest.approx(20 * math.log10(0.2 / math.sqrt(2)), abs=0.01)
    assert "near_silent" in rows["silent"]["why"]
    assert rows["none"]["rms"] is None and "no_pcm_samples" in rows["none"]["why"]
    assert rows["loud"]["duration"] is None and rows["loud"]["clipping"] == 0.5


def test_split_bundle_refuses_an_empty_split(spark, tmp_path):
    df = spark.createDataFrame([("train", 1), ("val", 2)], "split string, id int")
    with pytest.raises(ValueError, match="test"):
        sinks.write_split_bundle(df, str(tmp_path / "x"), "split", ("train", "val", "test"), ("id",))
    assert not (tmp_path / "x").exists()
    assert sinks.write_split_bundle(df, str(tmp_path / "x"), "split", ("train", "val"), ("id",)).count() == 2


def test_csv_sink_and_report(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], True)], "id string, paths array<string>, ok boolean")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()[1:] == ("x|y", "yes")
    rows = [("m", float("nan")), ("n", 1.5)] + [(f"k{i}", float(i)) for i in range(3000)]
    sinks.write_report({"t": spark.createDataFrame(rows, "k string, v double")}, str(tmp_path / "r"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "r" / "t.md").glob("part-*")))
    lines = text.splitlines()
    assert lines[:4] == ["## t", "", "| k | v |", "| --- | --- |"] and len(lines) == 4 + len(rows)
    assert "| n | 1.5000 |" in lines and "| m |  |" in lines and "nan" not in text.lower()
    assert spark.read.json(str(tmp_path / "r" / "t")).count() == len(rows)


def test_metric_stream_restarts_without_repeats(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.makedirs(source)

    def line(run, epoch, value):
        return json.dumps({"run": run, "epoch": epoch, "val": {"mae": value}})

    def go():
        streams.metric_monitor(spark, source, SC.METRIC_LOG, "run", "epoch", F.try_element_at("val", F.lit("mae")), 2.0, out, state).awaitTermination()
        return {r["run"]: (r["n_steps"], r["latest"], r["best"], r["reached"]) for r in streams.latest_per_key(spark, out, ["run"]).collect()}

    (tmp_path / "in" / "a.json").write_text("\n".join([line(1, 1, 5.0), line(1, 2, 4.0), line(2, 1, 9.0), "{broken"]))
    assert go() == {1: (2, 4.0, 4.0, False), 2: (1, 9.0, 9.0, False)}
    (tmp_path / "in" / "b.json").write_text(line(1, 3, 1.5) + "\n" + line(1, 4, 3.0))
    assert go() == {1: (4, 3.0, 1.5, True), 2: (1, 9.0, 9.0, False)}
    assert go() == {1: (4, 3.0, 1.5, True), 2: (1, 9.0, 9.0, False)}


def stream_of(spark, folder):
    return spark.readStream.schema("id long, content string, value double, ts timestamp").json(folder)


def events(path, rows):
    path.write_text("\n".join(json.dumps({"id": i, "content": c, "value": v, "ts": f"2024-01-{d:02d} 10:00:00"}) for i, c, v, d in rows))


def test_intake_stream_restarts(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.makedirs(source)

    def go():
        rules = {"low": F.col("value") < 1}
        streams.item_intake(stream_of(spark, source), "id", "ts", "5 days", rules, F.md5("content"), out, state).awaitTermination()
        return sorted((r["verdict"], r["content"], r["reason"]) for r in spark.read.parquet(out).collect())

    events(tmp_path / "in" / "a.json", [(1, "x", 5.0, 1), (2, "x", 6.0, 1), (3, "y", 0.0, 1), (4, "y", 0.0, 1)])
    first = [("accepted", "x", None), ("rejected", "y", "low"), ("rejected", "y", "low")]
    assert go() == first
    events(tmp_path / "in" / "b.json", [(5, "x", 7.0, 2), (6, "y", 2.0, 2)])
    both = [("accepted", "x", None), ("accepted", "y", None), *first[1:]]
    assert go() == both
    assert go() == both


def test_drift_stream_restarts(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.makedirs(source)
    reference = spark.createDataFrame([("x", 1.0, 2.0)], "content string, mean double, std double")

    def go():
        streams.drift_windows(stream_of(spark, source), "ts", "1 day", "2 days", "content", "value", reference, out, state).awaitTermination()
        return {(str(r["start"])[:10], r["content"]): (r["n"], r["std_units"]) for r in streams.latest_per_key(spark, out, ["start", "content"]).collect()}

    events(tmp_path / "in" / "a.json", [(1, "x", 5.0, 1), (2, "z", 6.0, 1)])
    assert go() == {("2024-01-01", "x"): (1, 2.0)}
    events(tmp_path / "in" / "b.json", [(3, "x", 1.0, 1), (4, "x", 3.0, 2)])
    assert go() == {("2024-01-01", "x"): (2, 1.0), ("2024-01-02", "x"): (1, 1.0)}
    assert go() == {("2024-01-01", "x"): (2, 1.0), ("2024-01-02", "x"): (1, 1.0)}


PLAIN = [
    "entry_prior_slices", "agg_ks", "agg_describe", "agg_pool_robust", "agg_sliced_metrics", "join_split_leakage", "flt_rule_cascade",
    "smp_stratified_split", "smp_split_objective", "win_running_best", "cal_soft_gated", "agg_duplicates", "scl_frame_stats", "join_specs_rows",
]


@pytest.mark.parametrize("name", PLAIN)
def test_plans_have_no_cross_joins_and_no_row_python(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan


def test_scans_are_pruned_and_filtered(spark):
    plan = entry.queries()["join_orphans"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan
    assert all("text" not in line for line in plan.splitlines() if "ReadSchema" in line)


@pytest.mark.parametrize("name", ["agg_pool_evidence", "smp_stratified_split", "agg_ks", "cal_soft_gated", "win_keep_first", "agg_duplicates"])
def test_huge_group_paths_give_the_same_rows(spark, monkeypatch, name):
    from rollcall.operators import grouped

    run = lambda: sorted(map(str, entry.queries()[name](spark, SF).select(sorted(entry.queries()[name](spark, SF).columns)).collect()))
    plain = run()
    monkeypatch.setattr(grouped, "GROUP_ROWS", 20)
    monkeypatch.setattr(grouped, "BROADCAST_ROWS", 5)
    assert run() == plain


def test_wide_predictions_are_one_aggregate_by_entity(spark):
    rows = [(1, 170.0, "a", 171.0), (1, 170.0, "b", 168.0), (1, 170.0, "a", 172.0), (2, 160.0, "b", None), (None, 150.0, "a", 151.0), (3, 1.0, "c", 2.0)]
    table = sinks.predictions_wide(spark.createDataFrame(rows, "e int, y double, c string, p double"), ["e"], "y", "c", "p", ["a", "b"])
    got = {tuple(r) for r in table.select("e", "y", "a", "b", "abs_err_a", "abs_err_b").collect()}
    assert got == {(1, 170.0, 172.0, 168.0, 2.0, 2.0), (2, 160.0, None, None, None, None), (None, 150.0, 151.0, None, 1.0, None), (3, 1.0, None, None, None, None)}
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1
