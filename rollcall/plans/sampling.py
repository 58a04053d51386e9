"""Queries for bins, strata, splits, folds, samples and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions.arrays import array_sum, frames_of
from rollcall.functions.numbers import target_bin
from rollcall.functions.weights import edge_weight
from rollcall.operators import sampling as S
from rollcall.operators.grouped import lookup_join, positions
from rollcall.plans.frames import vectors
from rollcall.plans.profile import rounded
from rollcall.plans.registry import query
from rollcall.plans.tables import entities, h01, hkey, items, with_sql

RATIOS = {"train": 0.7, "val": 0.15, "test": 0.15}


def binned(spark: SparkSession, sf: str) -> DataFrame:
    """Entities with quantile bins of age and weight and the stratum built from them."""
    rows = entities(spark, sf).drop("split")
    age = S.quantile_edges(rows, "age", 4)
    weight = S.quantile_edges(rows.filter("source = 'ASIA'"), "weight", 3)
    rows = rows.withColumns({"_ea": age, "_ew": weight})
    rows = rows.withColumns(
        {
            "age_bin": S.quantile_bin(F.col("age"), F.col("_ea"), "age"),
            "weight_bin": S.quantile_bin(F.col("weight"), F.col("_ew"), "weight", missing="weight_na"),
        }
    ).drop("_ea", "_ew")
    label = F.when(F.col("g") == 1, "Male").otherwise("Female")
    return rows.withColumn("stratum", S.stratum(label, target_bin(F.col("y")), F.col("age_bin"), F.col("weight_bin")))


def _bin_sql(col: str, edges: str, prefix: str, missing: str) -> str:
    place = f"len(list_filter({edges}[1:len({edges}) - 1], lambda e: e <= {col}))"
    return f"CASE WHEN {col} IS NULL THEN '{missing}' WHEN {place} = 0 THEN 'unknown' ELSE concat('{prefix}_q', {place}) END"


_BINNED = f"""ea AS (SELECT list_sort(list_distinct(quantile_cont(age, [0, 0.25, 0.5, 0.75, 1]))) AS ea FROM ent),
  ew AS (SELECT list_sort(list_distinct(quantile_cont(weight, [0, 1/3.0::DOUBLE, 2/3.0::DOUBLE, 1]))) AS ew FROM ent WHERE source = 'ASIA'),
  bn AS (SELECT ent.* EXCLUDE (split, _u), {_bin_sql('age', 'ea', 'age', 'unknown')} AS age_bin, {_bin_sql('weight', 'ew', 'weight', 'weight_na')} AS weight_bin FROM ent, ea, ew),
  st AS (SELECT *, concat_ws('|', CASE WHEN g = 1 THEN 'Male' ELSE 'Female' END, CASE WHEN y < 160 THEN 'short' WHEN y < 175 THEN 'medium' ELSE 'tall' END, age_bin, weight_bin) AS stratum FROM bn)"""


@query("smp_quantile_bins", with_sql("ent", more=_BINNED) + "SELECT entity_id, age_bin, weight_bin FROM bn")
def quantile_bins(spark: SparkSession, sf: str) -> DataFrame:
    return binned(spark, sf).select("entity_id", "age_bin", "weight_bin")


@query("smp_strata", with_sql("ent", more=_BINNED) + "SELECT source, stratum, count(*) AS n FROM st GROUP BY 1, 2")
def strata(spark: SparkSession, sf: str) -> DataFrame:
    return binned(spark, sf).groupBy("source", "stratum").agg(F.count(F.lit(1)).alias("n"))


def split_sql(table: str, keys: str, seed: str, out: str, hash_cols: tuple[str, ...]) -> str:
    """CTEs of the stratified split with leftovers placed level by level; result in ``out``."""
    h = hkey(seed, *hash_cols)
    return f"""{out}_r AS (SELECT *, row_number() OVER (PARTITION BY {keys}, stratum ORDER BY {h}, entity_id) AS pos, count(*) OVER (PARTITION BY {keys}, stratum) AS n, {h} AS h FROM {table}),
      {out}_a AS (SELECT *, floor(n * 0.7::DOUBLE) AS a, floor(n * 0.15::DOUBLE) AS b FROM {out}_r),
      {out}_s AS (SELECT *, CASE WHEN pos <= a THEN 'train' WHEN pos <= a + b THEN 'val' WHEN pos <= a + b + b THEN 'test' END AS split FROM {out}_a),
      {out}_t AS (SELECT {keys}, round_even(count(*) * 0.7::DOUBLE, 0) AS wt, round_even(count(*) * 0.15::DOUBLE, 0) AS wv, count(*) AS tot, count(*) FILTER (WHERE split = 'train') AS gt,
        count(*) FILTER (WHERE split = 'val') AS gv, count(*) FILTER (WHERE split = 'test') AS gs FROM {out}_s GROUP BY {keys}),
      {out}_d AS (SELECT {keys}, unnest([{{'o': 0, 's': 'train', 'd': (wt - gt)::BIGINT}}, {{'o': 1, 's': 'val', 'd': (wv - gv)::BIGINT}}, {{'o': 2, 's': 'test', 'd': (tot - wt - wv - gs)::BIGINT}}], recursive := true) FROM {out}_t),
      {out}_p AS (SELECT {keys}, s, row_number() OVER (PARTITION BY {keys} ORDER BY lv DESC, o) AS rk FROM (SELECT {keys}, o, s, unnest(range(1, d + 1)) AS lv FROM {out}_d WHERE d > 0)),
      {out}_l AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY h, entity_id) AS rk FROM {out}_s WHERE split IS NULL),
      {out} AS (SELECT {keys}, entity_id, stratum, split FROM {out}_s WHERE split IS NOT NULL UNION ALL
        SELECT {keys}, entity_id, stratum, coalesce(p.s, 'train') FROM {out}_l l LEFT JOIN {out}_p p USING ({keys}, rk))"""


@query(
    "smp_stratified_split",
    with_sql("ent", more=f"{_BINNED}, {split_sql('st', 'source', '42', 'sp', ('source', 'entity_id'))}") + "SELECT entity_id, source, stratum, split FROM sp",
)
def stratified(spark: SparkSession, sf: str) -> DataFrame:
    return S.stratified_split(binned(spark, sf), "entity_id", ["source"], "stratum", RATIOS, 42)


@query(
    "smp_group_split_2stage",
    with_sql("ent", more=f"one_ AS (SELECT 'all' AS source, g::VARCHAR AS stratum, entity_id FROM ent), {split_sql('one_', 'source', '5', 'sp', ('source', 'entity_id'))}")
    + "SELECT entity_id, stratum, split FROM sp",
)
def two_stage(spark: SparkSession, sf: str) -> DataFrame:
    rows = entities(spark, sf).select("entity_id", F.lit("all").alias("source"), F.col("g").cast("string").alias("stratum"))
    return S.stratified_split(rows, "entity_id", ["source"], "stratum", RATIOS, 5).select("entity_id", "stratum", "split")


_OBJ = """{k}klong AS (SELECT * FROM (SELECT seed, split, unnest([{{'metric': 'y', 'value': y}}, {{'metric': 'age', 'value': age}}, {{'metric': 'weight', 'value': weight}}], recursive := true) FROM {t}) WHERE value IS NOT NULL),
  {k}c AS (SELECT seed, metric, value, count(*) FILTER (WHERE split = 'train') AS a, count(*) FILTER (WHERE split = 'val') AS b, count(*) FILTER (WHERE split = 'test') AS t FROM {k}klong GROUP BY 1, 2, 3),
  {k}r AS (SELECT seed, metric, sum(a) OVER w / sum(a) OVER p AS fa, sum(b) OVER w / sum(b) OVER p AS fb, sum(t) OVER w / sum(t) OVER p AS ft FROM {k}c WINDOW w AS (PARTITION BY seed, metric ORDER BY value ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY seed, metric)),
  {k}d AS (SELECT seed, avg(d) AS avg_ks FROM (SELECT seed, metric, max(abs(fa - fb)) AS d FROM {k}r GROUP BY 1, 2 UNION ALL SELECT seed, metric, max(abs(fa - ft)) FROM {k}r GROUP BY 1, 2) GROUP BY 1),
  {k}p AS (SELECT seed, sum(off) AS penalty FROM (SELECT seed, source, (abs(count(*) FILTER (WHERE split = 'train') - 0.7::DOUBLE * count(*)) + abs(count(*) FILTER (WHERE split = 'val') - 0.15::DOUBLE * count(*)) + abs(count(*) FILTER (WHERE split = 'test') - 0.15::DOUBLE * count(*))) / count(*) AS off FROM {t} GROUP BY 1, 2) GROUP BY 1),
  {k}o AS (SELECT seed, avg_ks, penalty, avg_ks * 100 + penalty * 2 AS objective FROM {k}d JOIN {k}p USING (seed))"""


@query(
    "smp_split_objective",
    with_sql("ent", more="es AS (SELECT g AS seed, * FROM ent), " + _OBJ.format(k="z", t="es"))
    + "SELECT seed AS g, round(avg_ks, 6) AS avg_ks, round(penalty, 6) AS penalty, round(objective, 6) AS objective FROM zo",
)
def objective(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.split_objective(entities(spark, sf), ["g"], "source", "split", ("y", "age", "weight"), RATIOS), 6)


SEEDS = range(42, 162)


@query(
    "smp_seed_sweep",
    with_sql("ent", more=f"{_BINNED}, sd AS (SELECT s.range::INT AS seed, st.* FROM st, range(42, 162) s), {split_sql('sd', 'seed, source', 'sweep', 'sp', ('seed', 'source', 'entity_id'))}, "
             + "sj AS (SELECT sp.seed, sp.source, sp.split, ent.y, ent.age, ent.weight FROM sp JOIN ent USING (entity_id)), " + _OBJ.format(k="z", t="sj"))
    + "SELECT seed, round(avg_ks, 6) AS avg_ks, round(penalty, 6) AS penalty, round(objective, 6) AS objective, seed = (SELECT arg_min(seed, (objective, seed)) FROM zo) AS chosen FROM zo",
)
def sweep(spark: SparkSession, sf: str) -> DataFrame:
    scores, winner = S.seed_sweep(binned(spark, sf), "entity_id", "source", "stratum", ("y", "age", "weight"), RATIOS, SEEDS)
    best = winner.agg(F.max("seed").alias("s")).select("s").scalar()
    return rounded(scores.withColumn("chosen", F.col("seed") == best), 6)


_SHIFT = "('0x' || substr(md5(concat('3:', stratum)), 1, 6))::BIGINT"


@query(
    "smp_stratified_folds",
    with_sql("ent")
    + f""", s AS (SELECT entity_id, concat_ws(':', source, g::VARCHAR) AS stratum FROM ent), n AS (SELECT least(5, min(n)) AS k FROM (SELECT count(*) AS n FROM s GROUP BY stratum))
       SELECT entity_id, stratum, ((row_number() OVER (PARTITION BY stratum ORDER BY md5(concat('3:', entity_id)), entity_id) - 1 + {_SHIFT}) % k)::INT AS fold FROM s, n""",
)
def folds(spark: SparkSession, sf: str) -> DataFrame:
    level = F.concat_ws(":", "source", F.col("g").cast("string"))
    return S.stratified_folds(entities(spark, sf), "entity_id", [level], 5, 3)


@query(
    "smp_weighted_replacement",
    with_sql("ent")
    + f""", w AS (SELECT entity_id, CASE WHEN y < 160 THEN 1.8::DOUBLE WHEN y >= 175 THEN 1.35 ELSE 1 END AS w FROM ent),
       c AS (SELECT entity_id, sum(w) OVER (ORDER BY entity_id ROWS UNBOUNDED PRECEDING) - w AS s FROM w), d AS (SELECT {h01('draw', 'entity_id')} * (SELECT sum(w) FROM w) AS u FROM ent)
       SELECT c.entity_id, count(*) AS n_drawn FROM d ASOF JOIN c ON d.u >= c.s GROUP BY 1""",
)
def with_replacement(spark: SparkSession, sf: str) -> DataFrame:
    rows = entities(spark, sf).select("entity_id", edge_weight(F.col("y")).alias("w"))
    return S.draw_with_replacement(rows, "entity_id", "w", "draw")


@query(
    "smp_weighted_no_replacement",
    with_sql("ent")
    + f""", a AS (SELECT entity_id, -ln(greatest({h01('es', 'entity_id')}, pow(2.0::DOUBLE, -53))) / CASE WHEN y < 160 THEN 1.8::DOUBLE WHEN y >= 175 THEN 1.35 ELSE 1 END AS a FROM ent)
       SELECT entity_id, round(a, 8) AS arrival FROM a ORDER BY a, entity_id LIMIT 200""",
)
def without_replacement(spark: SparkSession, sf: str) -> DataFrame:
    out = S.draw_without_replacement(entities(spark, sf), "entity_id", edge_weight(F.col("y")), 200, "es")
    return rounded(out, 8)


def batch_sql(per: int, paired: int, clips: int) -> str:
    return f""", o AS (SELECT entity_id, row_number() OVER (ORDER BY md5(concat('9:2:', entity_id)), entity_id) - 1 AS p FROM (SELECT DISTINCT entity_id FROM items)),
       r AS (SELECT entity_id, item_id, row_number() OVER (PARTITION BY entity_id ORDER BY md5(concat('9:2:', entity_id, ':', item_id)), item_id) AS rk FROM items),
       f AS (SELECT *, max(rk) OVER (PARTITION BY entity_id) AS have FROM r WHERE rk <= {clips}),
       j AS (SELECT p // {per} AS batch, entity_id, item_id, rk, have, CASE WHEN p % {per} < {paired} THEN {clips} ELSE 1 END AS wanted FROM f JOIN o USING (entity_id))
       SELECT batch::BIGINT AS batch, entity_id, item_id, unnest(range(rk, wanted + 1, have))::BIGINT AS copy FROM j WHERE rk <= wanted"""


@query("smp_entity_batches", with_sql("items") + batch_sql(8, 8, 4))
def entity_batches(spark: SparkSession, sf: str) -> DataFrame:
    return S.entity_batches(items(spark, sf), "entity_id", "item_id", per_batch=8, paired=8, clips=4, seed=9, epoch=2)


@query("smp_hybrid_batches", with_sql("items") + batch_sql(10, 4, 2))
def hybrid_batches(spark: SparkSession, sf: str) -> DataFrame:
    return S.entity_batches(items(spark, sf), "entity_id", "item_id", per_batch=10, paired=4, clips=2, seed=9, epoch=2)


@query(
    "smp_balanced_weights",
    with_sql("ent")
    + """, c AS (SELECT g, least(greatest(1.0 + 0.2 * ((SELECT count(*) FROM ent) / (2.0::DOUBLE * count(*)) - 1.0), 0.8), 1.25) AS prior FROM ent GROUP BY g)
       SELECT entity_id, round(least(4.0, CASE WHEN y < 160 THEN 1.8 WHEN y < 175 THEN 1.0 ELSE 1.15 END * prior * CASE source WHEN 'ASIA' THEN 1.2 ELSE 1 END * CASE WHEN g = 1 AND y < 160 THEN 1.9 ELSE 1 END), 6) AS weight FROM ent JOIN c USING (g)""",
)
def balanced(spark: SparkSession, sf: str) -> DataFrame:
    rows = entities(spark, sf).withColumn("bin", target_bin(F.col("y")))
    out = S.balanced_weights(
        rows, "entity_id", "bin", "g", "source", {"short": 1.8, "medium": 1.0, "tall": 1.15}, {"ASIA": 1.2}, {"1_short": 1.9}
    )
    return rounded(out, 6)


@query(
    "smp_hash_subset",
    with_sql("items") + "SELECT entity_id FROM (SELECT DISTINCT entity_id FROM items) ORDER BY md5(concat('42:', entity_id)), entity_id LIMIT 100",
)
def hash_subset(spark: SparkSession, sf: str) -> DataFrame:
    return S.hash_subset(items(spark, sf), "entity_id", 100, 42)


@query(
    "smp_variant_plan",
    with_sql("ent", "items")
    + """, i AS (SELECT entity_id, split, source, (row_number() OVER (PARTITION BY entity_id ORDER BY item_id) - 1)::INT AS item_no FROM items JOIN ent USING (entity_id)),
       t AS (SELECT *, CASE WHEN split = 'train' THEN 1 + CASE WHEN source = 'ASIA' THEN 2 ELSE 0 END ELSE 0 END AS total FROM i)
       SELECT entity_id, item_no, v AS variant, concat(entity_id, '_', lpad(item_no::VARCHAR, 3, '0'), '_aug', lpad(v::VARCHAR, 2, '0')) AS name FROM (SELECT *, unnest(range(0, total))::INT AS v FROM t WHERE total > 0)""",
)
def variants(spark: SparkSession, sf: str) -> DataFrame:
    numbered = positions(items(spark, sf).select("entity_id", "item_id"), ["entity_id"], ["item_id"], "item_no")
    rows = lookup_join(numbered.withColumn("item_no", (F.col("item_no") - 1).cast("int")), entities(spark, sf).select("entity_id", "split", "source"), ["entity_id"], "inner")
    return S.variant_plan(rows, "entity_id", "item_no", F.col("split"), F.col("source"), 1, {"ASIA": 2})


@query("smp_feature_masking")
def masking(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf).select("vec_id", frames_of(F.col("v"), 12).alias("frames"))
    out = S.mask_frames(rows, "vec_id", "frames", 12, seed=21, epoch=10, min_drop=4)
    return out.select(
        "vec_id", F.size("frames").alias("n_frames"),
        F.size(F.filter(F.flatten("frames"), lambda x: x == 0.0)).alias("n_zero"), F.round(array_sum(F.flatten("frames")), 6).alias("total"),
    )
