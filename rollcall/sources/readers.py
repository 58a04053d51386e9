"""Readers: manifests, master lists, listings, item stores, metric logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall import schema as S
from rollcall.functions import labels as L
from rollcall.functions import numbers as N
from rollcall.functions.quality import first_reason

BOM = "﻿"


def read_manifest(spark: SparkSession, path: str, schema: T.StructType = S.MANIFEST, required: bool = True) -> DataFrame:
    """CSV with a header, UTF-8 with or without a byte order mark; empty is an error if required."""
    table = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    first = schema.fieldNames()[0]
    table = table.withColumn(first, F.regexp_replace(first, f"^{BOM}", ""))
    if required and table.isEmpty():
        raise ValueError(f"no rows in {path}")
    return table


def list_lines(spark: SparkSession, path: str, comments: Sequence[str]) -> DataFrame:
    """Trimmed, non-comment lines and their whitespace-separated fields."""
    line = F.trim("value")
    skipped = line == ""
    for mark in comments:
        skipped = skipped | line.startswith(mark)
    return spark.read.text(path).filter(~skipped).select(line.alias("line"), F.split(line, r"\s+").alias("f"))


# Id prefix to folder of the first list format.
FOLDERS = {"Hin": "Hindi_master", "Kan": "Kannada_master", "Mal": "Malayalam_master", "Tam": "Tamil_master", "Tel": "Telugu_master"}


def read_master_list_a(spark: SparkSession, path: str, prefix: str = "NISP") -> DataFrame:
    """First list format; lines that cannot be used carry a reason.

    Fields: id, label, -, height, -, -, weight, age, ...
    """
    rows = list_lines(spark, path, (";", "#", "Speaker_ID"))
    at = lambda i: F.get("f", F.lit(i))
    folders = F.create_map(*[F.lit(x) for pair in FOLDERS.items() for x in pair])
    height, weight, age = (N.safe_number(at(i)) for i in (3, 6, 7))
    folder = F.try_element_at(folders, F.get(F.split(at(0), "_"), F.lit(0)))
    reason = first_reason({
        "too few fields": F.size("f") < 8,
        "malformed number": height.isNull() | weight.isNull() | age.isNull(),
        "unknown prefix": folder.isNull(),
    })
    return rows.select(
        F.concat(F.lit(f"{prefix}_"), at(0)).alias("entity_id"), F.lit(prefix).alias("source"), L.plain_label(at(1)).alias("label"),
        height.alias("height"), weight.alias("weight"), F.bround(age).cast("int").alias("age"),
        F.concat(folder, F.lit("/"), F.get(F.split(at(0), "_"), F.lit(1))).alias("folder"), reason.alias("reason"),
    )


def read_master_list_b(spark: SparkSession, path: str, prefix: str = "TIMIT") -> DataFrame:
    """Second list format: imperial height and two dates.

    Fields: id, label, region, use, recorded, born, height, ...
    """
    rows = list_lines(spark, path, (";",))
    at = lambda i: F.get("f", F.lit(i))
    height = N.imperial_to_cm(at(6))
    label = F.when(F.upper(at(1)) == "M", "Male").when(F.upper(at(1)) == "F", "Female").otherwise("Unknown")
    reason = first_reason({"too few fields": F.size("f") < 7, "malformed height": height.isNull()})
    return rows.select(
        F.concat(F.lit(f"{prefix}_"), at(0)).alias("entity_id"), F.lit(prefix).alias("source"), label.alias("label"),
        height.alias("height"), F.lit(None).cast("double").alias("weight"), N.derive_age(at(4), at(5)).alias("age"),
        F.concat(F.upper(at(1)), F.upper(at(0))).alias("folder"), reason.alias("reason"),
    )


def any_case_glob(suffix: str) -> str:
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)


def list_files(spark: SparkSession, root: str, suffix: str = ".wav") -> DataFrame:
    """Files under a root by suffix, any case; contents are not read.  Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", any_case_glob(suffix)).load(root)
    return files.select("path", "length", "modificationTime")


def read_item_store(
    spark: SparkSession, path: str, schema: T.StructType = S.ITEM_FEATURES, defaults: Mapping[str, object] = S.ITEM_DEFAULTS
) -> DataFrame:
    """Partitioned item store; fields the files lack read as their default, NaN as missing."""
    table = spark.read.schema(schema).parquet(path)
    kinds = dict(table.dtypes)
    columns: list[Column] = []
    for name in table.columns:
        value = N.finite(F.col(name)) if kinds[name] == "double" else F.col(name)
        columns.append((F.coalesce(value, F.lit(defaults[name])) if name in defaults else value).alias(name))
    return table.select(*columns)


def complete_views(df: DataFrame, view: str, split: str, splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Views that exist in every split."""
    return df.filter(F.col(split).isin(*splits)).groupBy(view).agg(
        F.count_distinct(split).alias("n_splits"), F.count(F.lit(1)).alias("n_rows")
    ).filter(F.col("n_splits") == len(splits)).drop("n_splits")


def read_metric_log(spark: SparkSession, path: str, schema: T.StructType = S.METRIC_LOG) -> DataFrame:
    """JSON lines; blank, invalid and non-object lines are left out."""
    wider = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType(), True)])
    table = spark.read.schema(wider).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("allowNonNumericNumbers", True).json(path)
    return table.filter(F.col("_corrupt").isNull()).drop("_corrupt")
