"""Sinks: split bundles, accept/reject tables, wide predictions, reports, guards."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions.hashing import table_fingerprint
from rollcall.session import settle
from rollcall.sources.readers import list_files

POLICIES = {"refuse": "errorifexists", "overwrite": "overwrite", "resume": "append"}


def write_guarded(df: DataFrame, path: str, policy: str, partition_by: Sequence[str] = ()) -> None:
    """Write under a named policy: refuse an existing table, replace it, or add to it."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; known: {', '.join(POLICIES)}")
    df.write.mode(POLICIES[policy]).partitionBy(*partition_by).parquet(path)


def write_split_bundle(df: DataFrame, path: str, split: str, splits: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Write one partition per split; returns rows and fingerprint per split.

    An empty split is an error, found before anything is written.
    """
    table = settle(df)
    prints = settle(table_fingerprint(table, columns, [split]))
    have = {r[split] for r in prints.select(split).collect()}
    empty = [s for s in splits if s not in have]
    if empty:
        raise ValueError(f"empty splits: {', '.join(empty)}")
    table.write.mode("errorifexists").partitionBy(split).parquet(path)
    return prints


def write_accept_reject(entities: DataFrame, items: DataFrame, path: str, reason: str = "reason", columns: Mapping[str, Sequence[str]] | None = None) -> list[str]:
    """Four tables: accepted and rejected entities and items, from two settled decisions."""
    written = []
    for name, table in (("entities", settle(entities)), ("items", settle(items))):
        keep = list((columns or {}).get(name, table.columns))
        for part, test in (("accepted", F.col(reason).isNull()), ("rejected", F.col(reason).isNotNull())):
            target = f"{path}/{part}_{name}"
            picked = table.filter(test)
            picked = picked.select(*keep) if part == "accepted" else picked
            picked.write.mode("errorifexists").parquet(target)
            written.append(target)
    return written


def predictions_wide(df: DataFrame, keys: Sequence[str], y: str, candidate: str, pred: str, names: Sequence[str]) -> DataFrame:
    """One prediction (the largest, were there several) and one absolute error column per candidate.

    One aggregate of fixed width: no task holds a row per candidate.
    """
    table = df.groupBy(*keys, y).agg(*[F.max(F.when(F.col(candidate) == n, F.col(pred))).alias(n) for n in names])
    return table.withColumns({f"abs_err_{n}": F.abs(F.col(n) - F.col(y)) for n in names})


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """CSV with header; lists become pipe lists and flags yes/no."""
    out = df.select(*columns) if columns else df
    for name, kind in out.dtypes:
        if kind.startswith("array"):
            out = out.withColumn(name, F.array_join(name, "|"))
        elif kind == "boolean":
            out = out.withColumn(name, F.when(F.col(name), "yes").when(~F.col(name), "no"))
    out.write.mode("errorifexists").option("header", True).csv(path)


def write_report(tables: Mapping[str, DataFrame], path: str) -> None:
    """Metric tables as one JSON-lines folder and one Markdown folder each (``name`` and ``name.md``).

    Spark writes both, whatever the number of rows; the part files of a Markdown
    folder, in order of their names, make up the table, head first.
    """
    for name, table in tables.items():
        clean = settle(table.select(*[F.nanvl(c, F.lit(None)).alias(c) if t == "double" else F.col(c) for c, t in table.dtypes]))
        clean.write.mode("errorifexists").json(f"{path}/{name}")
        cells = [F.when(F.col(c).isNull(), "").otherwise(F.format_string("%.4f", c) if t == "double" else F.col(c).cast("string")) for c, t in clean.dtypes]
        line = F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |"))
        head = [f"## {name}", "", "| " + " | ".join(table.columns) + " |", "|" + " --- |" * len(table.columns)]
        top = clean.sparkSession.createDataFrame([(i, t) for i, t in enumerate(head)], "place long, value string")
        rows = clean.select((F.monotonically_increasing_id() + len(head)).alias("place"), line.alias("value"))
        top.unionByName(rows).orderBy("place").select("value").write.mode("errorifexists").text(f"{path}/{name}.md")


def _opened(path: str) -> pa.NativeFile:
    """A stream on a path as Spark lists it: its characters stand for themselves, %20 as well."""
    scheme, host, place = re.fullmatch(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/]*))?(/.*)", path, re.DOTALL).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem().open_input_stream(place)
    store, root = fs.FileSystem.from_uri(f"{scheme}://{host or ''}/")
    return store.open_input_stream(root.rstrip("/") + place)


def integrity_manifest(spark: SparkSession, root: str, suffix: str, chunk: int = 4 << 20) -> DataFrame:
    """sha256 and size of every input file that is not empty (Spark lists no others).

    Spark lists the files and deals them to tasks by size; a task streams one file at a time
    and holds ``chunk`` bytes of it, so a file may be larger than a cell (2 GiB).  The size is
    that of the bytes read.  ``root`` lies on a file system that ``pyarrow.fs`` opens.
    """

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path in part.column(0).to_pylist():
                digest, size = hashlib.sha256(), 0
                with _opened(path) as stream:
                    while block := stream.read(chunk):
                        digest.update(block)
                        size += len(block)
                yield pa.RecordBatch.from_pydict({"path": [path], "sha256": [digest.hexdigest()], "bytes": [size]})

    return list_files(spark, root, suffix).select("path").mapInArrow(work, "path string, sha256 string, bytes bigint")


def missing_outputs(wanted: DataFrame, existing: DataFrame, key: Sequence[str]) -> DataFrame:
    """Items whose outputs do not exist yet."""
    return wanted.join(existing.select(*key).distinct(), list(key), "left_anti")


def resume(spark: SparkSession, wanted: DataFrame, path: str, key: Sequence[str], compute) -> DataFrame:
    """Compute what is missing and add it; a second run adds nothing."""
    compute(wanted.limit(0)).write.mode("append").parquet(path)  # makes sure the table exists
    todo = settle(missing_outputs(wanted, spark.read.parquet(path), key))
    compute(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)


