"""The given tables seen as entities, items and predictions.

Each view exists twice: as a DataFrame and as the SQL fragment that the SQL
twins build on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions.hashing import hash_uniform

SPLITS = ("train", "val", "test")
FIRST_GROUP = ("AUTOMOBILE", "BUILDING", "FURNITURE")
WEIGHED = ("ASIA", "EUROPE")
# candidate, slope, offset, noise width
CANDIDATES = (
    ("medium_weighted__blend", 0.95, 9.0, 20.0),
    ("ridge__base", 0.9, 17.0, 12.0),
    ("ridge__wide", 0.8, 33.0, 16.0),
    ("short_weighted__low", 0.7, 48.0, 10.0),
    ("tree__deep", 1.0, 0.5, 24.0),
)


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def split_of(uniform: Column) -> Column:
    return F.when(uniform < 0.7, "train").when(uniform < 0.85, "val").otherwise(F.lit("test"))


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as entities with source, group, target, age, weight and split."""
    places = (
        load(spark, sf, "nation")
        .join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("source"))
    )
    return (
        load(spark, sf, "customer")
        .join(places, "c_nationkey")
        .select(
            F.col("c_custkey").alias("entity_id"),
            "source",
            F.col("c_mktsegment").alias("segment"),
            F.col("c_mktsegment").isin(*FIRST_GROUP).cast("int").alias("g"),
            (F.lit(140.0) + (F.col("c_acctbal") + 1000.0) * 60.0 / 11000.0).alias("y"),
            (F.lit(16) + F.col("c_custkey") % 65).cast("double").alias("age"),
            F.when(F.col("source").isin(*WEIGHED), F.lit(38) + F.col("c_custkey") * 7 % 85)
            .cast("double")
            .alias("weight"),
            split_of(hash_uniform("split", F.col("c_custkey").cast("string"))).alias("split"),
        )
    )


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as items with a prediction, a variance and quality fields."""
    key = F.col("o_orderkey")
    return load(spark, sf, "orders").select(
        key.alias("item_id"),
        F.col("o_custkey").alias("entity_id"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_orderpriority").alias("label"),
        (F.lit(140.0) + F.col("o_totalprice") % F.lit(6000.0) / 100.0).alias("pred"),
        (F.lit(1.0) + key % 37).alias("var"),
        (key % 101 / F.lit(100.0)).alias("quality"),
        (key % 97 / F.lit(96.0)).alias("speech"),
        (key % 41 - F.lit(5.0)).alias("snr"),
        (key % 13 / F.lit(100.0)).alias("clipped"),
        (F.lit(10.0) + key % 60).alias("distance"),
        (key % 89 / F.lit(88.0)).alias("voiced"),
        (key % 25 / F.lit(2.0)).alias("duration"),
        (F.lit(20) + key % 300).cast("double").alias("frames"),
        F.when(key % 5 != 0, key % 7 / F.lit(2.0) - 1.5).alias("drift"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Long prediction table: one row per entity and candidate."""
    specs = F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.lit(s).alias("slope"), F.lit(o).alias("shift"), F.lit(w).alias("width"))
            for n, s, o, w in CANDIDATES
        ]
    )
    rows = entities(spark, sf).withColumn("spec", F.explode(specs))
    noise = hash_uniform("noise", F.col("spec.name"), F.col("entity_id").cast("string")) - 0.5
    return rows.select(
        "entity_id", "split", "source", "segment", "g", "y",
        F.col("spec.name").alias("candidate"),
        (F.col("spec.slope") * F.col("y") + F.col("spec.shift") + noise * F.col("spec.width")).alias("pred"),
    )


def one_candidate(spark: SparkSession, sf: str, name: str = "ridge__base") -> DataFrame:
    return predictions(spark, sf).filter(F.col("candidate") == name).drop("candidate")


def h01(seed: str, *cols: str) -> str:
    joined = ", ':', ".join(f"({c})::VARCHAR" for c in cols)
    return f"(('0x' || substr(md5(concat('{seed}:', {joined})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def hkey(seed: object, *cols: str) -> str:
    joined = ", ':', ".join(f"({c})::VARCHAR" for c in cols)
    return f"md5(concat('{seed}:', {joined}))"


_ENT = f"""
ent AS (
  SELECT *, CASE WHEN _u < 0.7 THEN 'train' WHEN _u < 0.85 THEN 'val' ELSE 'test' END AS split
  FROM (
    SELECT c_custkey AS entity_id, r_name AS source, c_mktsegment AS segment,
           CASE WHEN c_mktsegment IN {FIRST_GROUP} THEN 1 ELSE 0 END AS g,
           140.0::DOUBLE + (c_acctbal + 1000.0::DOUBLE) * 60.0::DOUBLE / 11000.0::DOUBLE AS y,
           (16 + c_custkey % 65)::DOUBLE AS age,
           CASE WHEN r_name IN {WEIGHED} THEN (38 + (c_custkey * 7) % 85)::DOUBLE END AS weight,
           {h01('split', 'c_custkey')} AS _u
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey))"""
_ITEMS = """
items AS (
  SELECT o_orderkey AS item_id, o_custkey AS entity_id, o_orderdate::DATE AS day, o_orderpriority AS label,
         140.0::DOUBLE + (o_totalprice % 6000.0::DOUBLE) / 100.0::DOUBLE AS pred,
         1.0::DOUBLE + o_orderkey % 37 AS var, (o_orderkey % 101) / 100.0::DOUBLE AS quality,
         (o_orderkey % 97) / 96.0::DOUBLE AS speech, (o_orderkey % 41) - 5.0::DOUBLE AS snr,
         (o_orderkey % 13) / 100.0::DOUBLE AS clipped, 10.0::DOUBLE + o_orderkey % 60 AS distance,
         (o_orderkey % 89) / 88.0::DOUBLE AS voiced, (o_orderkey % 25) / 2.0::DOUBLE AS duration,
         (20 + o_orderkey % 300)::DOUBLE AS frames,
         CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 7) / 2.0::DOUBLE - 1.5::DOUBLE END AS drift
  FROM orders)"""
_PREDS = f"""
preds AS (
  SELECT entity_id, split, source, segment, g, y, candidate,
         slope * y + shift + ({h01('noise', 'candidate', 'entity_id')} - 0.5::DOUBLE) * width AS pred
  FROM ent CROSS JOIN (SELECT name AS candidate, slope::DOUBLE AS slope, shift::DOUBLE AS shift, width::DOUBLE AS width
    FROM (VALUES {", ".join(str(c) for c in CANDIDATES)}) v(name, slope, shift, width)))"""
_ONE = """
one AS (SELECT * EXCLUDE (candidate) FROM preds WHERE candidate = 'ridge__base')"""
_PARTS = {"ent": _ENT, "items": _ITEMS, "preds": _PREDS, "one": _ONE}
_NEEDS = {"ent": (), "items": (), "preds": ("ent",), "one": ("ent", "preds")}


def with_sql(*names: str, more: str = "") -> str:
    """WITH clause holding the named views and ``more`` CTEs after them."""
    wanted: list[str] = []
    for name in names:
        for part in (*_NEEDS[name], name):
            if part not in wanted:
                wanted.append(part)
    parts = [_PARTS[n] for n in wanted]
    if more:
        parts.append(more)
    return "WITH " + ",".join(parts) + "\n"


def rnd(expr: str, digits: int = 4) -> str:
    return f"round({expr}, {digits})"
