"""Queries for joins, audits and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions import hashing as H
from rollcall.functions import labels as L
from rollcall.operators import audit as A
from rollcall.operators import sets as S
from rollcall.operators.grouped import lookup_join
from rollcall.plans.registry import query
from rollcall.plans.scalars import words
from rollcall.plans.tables import entities, h01, items, load, one_candidate, split_of, with_sql


@query(
    "join_meta_features",
    """WITH k AS (SELECT coalesce(c_custkey, vec_id) AS id, CASE WHEN c_custkey IS NULL THEN 'right_only' WHEN vec_id IS NULL THEN 'left_only' ELSE 'both' END AS side
         FROM (SELECT c_custkey FROM customer WHERE c_custkey % 40 <> 7) c FULL JOIN (SELECT DISTINCT vec_id FROM embeddings) e ON c_custkey = vec_id)
       SELECT side, count(*) AS n, array_to_string(list_sort(list(id))[1:3], '|') AS examples FROM k GROUP BY side""",
)
def meta_features(spark: SparkSession, sf: str) -> DataFrame:
    left = load(spark, sf, "customer").filter("c_custkey % 40 <> 7").select(F.col("c_custkey").alias("id"))
    right = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    return A.completeness(left, right, "id")


@query(
    "join_views_aligned",
    """SELECT vec_id AS id, CASE WHEN vec_id % 60 = 1 THEN 'missing_b' WHEN vec_id % 50 = 2 THEN 'target_b' WHEN vec_id % 70 = 3 THEN 'target_base' END AS problem
       FROM embeddings WHERE vec_id % 60 = 1 OR vec_id % 50 = 2 OR vec_id % 70 = 3""",
)
def views_aligned(spark: SparkSession, sf: str) -> DataFrame:
    key, y = F.col("vec_id"), F.col("label").cast("double")
    rows = load(spark, sf, "embeddings")
    a = rows.select(key.alias("id"), y.alias("y"), F.slice("embedding", 1, 32).alias("emb"))
    b = rows.filter("vec_id % 60 <> 1").select(
        key.alias("id"), F.when(key % 50 == 2, y + 1).otherwise(y + 0.0005).alias("y"), F.slice("embedding", 33, 32).alias("emb")
    )
    base = rows.select(key.alias("id"), F.when(key % 70 == 3, y - 1).otherwise(y + 0.01).alias("y"))
    return A.align_views({"a": a, "b": b}, base, "id", "y")[1]


def references(spark: SparkSession, sf: str) -> DataFrame:
    """Entities with path lists: repeats, and paths that do not exist, as many more as three for ten documents."""
    key = F.col("c_custkey")
    paths = load(spark, sf, "documents").agg(F.floor(F.count(F.lit(1)) * 13 / 10).cast("long").alias("m")).select("m").scalar()
    path = lambda n: F.concat(F.lit("doc/"), n.cast("string"))
    both = F.array(path(key * 2 % paths), path(key * 14 % paths), path(key * 2 % paths), path(key * 6 % paths))
    none = F.array(F.lit("doc/none"))
    return load(spark, sf, "customer").select(
        key.alias("entity_id"), F.when(key % 45 == 0, none).otherwise(both).alias("paths")
    )


def listing(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").filter("doc_id % 5 <> 0").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path")
    )


_REFS = """refs AS (SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 45 = 0 THEN ['doc/none'] ELSE
  [concat('doc/', c_custkey * 2 % m), concat('doc/', c_custkey * 14 % m), concat('doc/', c_custkey * 2 % m), concat('doc/', c_custkey * 6 % m)] END AS l FROM customer, (SELECT count(*) * 13 // 10 AS m FROM documents)),
u AS (SELECT entity_id, len(l) AS n_raw, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM refs),
have AS (SELECT list(concat('doc/', doc_id)) AS h FROM documents WHERE doc_id % 5 <> 0)"""


@query(
    "join_missing_refs",
    f"""WITH {_REFS} SELECT entity_id, n_raw - len(l) AS n_deduped, len(list_filter(l, lambda x: NOT list_contains(h, x)))::BIGINT AS n_missing,
         array_to_string(list_filter(l, lambda x: list_contains(h, x)), '|') AS kept, len(list_filter(l, lambda x: list_contains(h, x))) = 0 AS removed FROM u, have""",
)
def missing_refs(spark: SparkSession, sf: str) -> DataFrame:
    kept, _ = A.resolve_refs(references(spark, sf), "entity_id", "paths", listing(spark, sf), "path")
    return kept.select(
        "entity_id", "n_deduped", "n_missing", L.join_list(F.col("paths")).alias("kept"), (F.size("paths") == 0).alias("removed")
    )


@query(
    "join_orphans",
    f"""WITH {_REFS} SELECT 'orphan' AS reason, concat('doc/', doc_id) AS original_path, 'not_referenced' AS details
        FROM documents WHERE doc_id % 5 <> 0 AND concat('doc/', doc_id) NOT IN (SELECT unnest(l) FROM u)""",
)
def orphan_files(spark: SparkSession, sf: str) -> DataFrame:
    refs = references(spark, sf).select(F.explode("paths").alias("path"))
    return A.orphans(listing(spark, sf), refs, "path")


def split_documents(spark: SparkSession, sf: str) -> DataFrame:
    u = H.hash_uniform("docs", F.col("doc_id").cast("string"))
    return load(spark, sf, "documents").withColumn("split", split_of(u))


_DOCS = f"""docs AS (SELECT *, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, {h01('docs', 'doc_id')} AS u FROM documents))"""


@query(
    "join_split_leakage",
    f"""WITH {_DOCS}, k AS (SELECT DISTINCT split, 'content' AS kind, sha256(text) AS key FROM docs UNION SELECT split, 'entity', concat(source, ':', lang) FROM docs
         UNION SELECT split, 'path', concat('/', source, '/', doc_id) FROM docs),
       pairs AS (SELECT * FROM (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test')) p(a, b) CROSS JOIN (VALUES ('content'), ('entity'), ('path')) d(kind)),
       hits AS (SELECT p.kind, a, b, list_sort(list(x.key)) AS l FROM pairs p JOIN k x ON x.split = a AND x.kind = p.kind JOIN k y ON y.split = b AND y.kind = p.kind AND y.key = x.key GROUP BY 1, 2, 3)
       SELECT p.kind, concat(p.a, '_', p.b) AS pair, coalesce(len(l), 0)::BIGINT AS shared, coalesce(array_to_string(l[1:10], '|'), '') AS examples, coalesce(len(l), 0) > 0 AS has_leakage
       FROM pairs p LEFT JOIN hits h ON p.kind = h.kind AND p.a = h.a AND p.b = h.b""",
)
def leakage(spark: SparkSession, sf: str) -> DataFrame:
    kinds = {
        "content": F.sha2("text", 256),
        "entity": F.concat_ws(":", "source", "lang"),
        "path": F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")),
    }
    return A.split_leakage(split_documents(spark, sf), "split", kinds)


@query(
    "join_disjoint_assert",
    with_sql("ent")
    + """, c AS (SELECT p_partkey * 2 AS id FROM part UNION ALL SELECT p_partkey FROM part WHERE p_partkey % 100 = 0),
       n AS (SELECT id, count(*) AS k FROM c GROUP BY id)
       SELECT id, 'duplicate_id' AS problem FROM n WHERE k > 1
       UNION ALL SELECT id, CASE WHEN split = 'train' THEN 'overlap_train' ELSE 'overlap_sealed' END FROM n JOIN ent ON id = entity_id""",
)
def disjoint(spark: SparkSession, sf: str) -> DataFrame:
    part = load(spark, sf, "part")
    collected = part.select((F.col("p_partkey") * 2).alias("id")).unionByName(
        part.filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("id"))
    )
    roles = entities(spark, sf).select(F.col("entity_id").alias("id"), "split")
    return A.disjoint_problems(collected, roles, "id")


@query(
    "join_hash_conflicts",
    """SELECT sha256(text) AS digest, count(DISTINCT source) AS n_owners, array_to_string(list_sort(list(DISTINCT source))[1:5], '|') AS owners
       FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1""",
)
def conflicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "documents").select(F.sha2("text", 256).alias("digest"), "source")
    return A.hash_conflicts(rows, "digest", "source")


@query(
    "join_external_preds",
    with_sql("preds")
    + """SELECT a.entity_id, round(a.pred, 4) AS pred, round(b.pred, 4) AS external FROM preds a JOIN preds b
         ON a.entity_id = b.entity_id AND a.candidate = 'ridge__base' AND b.candidate = 'tree__deep'""",
)
def external(spark: SparkSession, sf: str) -> DataFrame:
    base = one_candidate(spark, sf).select("entity_id", "y", "pred")
    other = one_candidate(spark, sf, "tree__deep").select("entity_id", F.round("y", 2).alias("y"), "pred")
    out = A.attach_external(base, other, "entity_id", "y", "pred")
    return out.select("entity_id", F.round("pred", 4).alias("pred"), F.round("external", 4).alias("external"))


_FP = """SELECT split, count(*) AS n, sum(('0x' || substr(sha256(to_json({'entity_id': entity_id, 'segment': segment})::VARCHAR), 1, 8))::BIGINT)::VARCHAR AS h FROM ent"""


@query(
    "join_contract_check",
    with_sql("ent")
    + f""", e AS ({_FP} GROUP BY split), r AS ({_FP} WHERE NOT (split = 'test' AND entity_id % 97 = 0) GROUP BY split),
       j AS (SELECT split, e.n::VARCHAR AS en, r.n::VARCHAR AS rn, e.h::VARCHAR AS eh, r.h::VARCHAR AS rh FROM e JOIN r USING (split))
       SELECT split, 'n_rows' AS field, en AS expected, rn AS recorded FROM j WHERE en <> rn
       UNION ALL SELECT split, 'hash_sum_0', eh, rh FROM j WHERE eh <> rh""",
)
def contract(spark: SparkSession, sf: str) -> DataFrame:
    rows = entities(spark, sf)
    changed = rows.filter(~((F.col("split") == "test") & (F.col("entity_id") % 97 == 0)))
    prints = [
        H.table_fingerprint(r, ("entity_id", "segment"), ("split",)).select("split", "n_rows", "hash_sum_0")
        for r in (rows, changed)
    ]
    return A.contract_violations(*prints, ["split"])


@query(
    "join_manifest_drift",
    with_sql("ent")
    + """SELECT split, entity_id, 'missing' AS drift FROM ent WHERE entity_id % 83 = 0
         UNION ALL SELECT 'train', entity_id, 'unexpected' FROM ent WHERE entity_id % 71 = 0 AND entity_id % 83 <> 0 AND split = 'val'
         UNION ALL SELECT 'val', entity_id, 'missing' FROM ent WHERE entity_id % 71 = 0 AND entity_id % 83 <> 0 AND split = 'val'""",
)
def drift(spark: SparkSession, sf: str) -> DataFrame:
    expected = entities(spark, sf).select("split", "entity_id")
    moved = F.when((F.col("entity_id") % 71 == 0) & (F.col("split") == "val"), "train").otherwise(F.col("split"))
    realised = expected.filter("entity_id % 83 <> 0").withColumn("split", moved)
    return A.manifest_drift(expected, realised, ["split", "entity_id"])


@query(
    "join_hash_index",
    r"""SELECT page_id, sha256(html) AS digest FROM pages WHERE page_id % 9 <> 0 UNION ALL SELECT page_id, NULL FROM pages WHERE page_id % 9 = 0""",
)
def hash_index(spark: SparkSession, sf: str) -> DataFrame:
    pages = load(spark, sf, "pages")
    path = F.concat(F.lit("data/"), F.col("page_id").cast("string"), F.lit("/"), F.regexp_replace("url", "^https?://", ""))
    index = pages.filter("page_id % 9 <> 0").select(path.alias("rel"), F.sha2("html", 256).alias("digest"))
    messy = F.when(F.col("page_id") % 2 == 0, F.replace(path, F.lit("/"), F.lit("\\"))).otherwise(path)
    wanted = pages.select("page_id", L.slashes(messy).alias("rel"))
    return wanted.join(index, "rel", "left").select("page_id", "digest")


@query(
    "join_small_params",
    with_sql("ent")
    + """, p AS (SELECT source, segment, avg(y) AS m FROM ent WHERE segment <> 'MACHINERY' GROUP BY source, segment)
       SELECT entity_id, round(coalesce(m, 170.0), 4) AS base, coalesce(m, 0) > 0 AND m IS NOT NULL AS known FROM ent LEFT JOIN p USING (source, segment)""",
)
def small_params(spark: SparkSession, sf: str) -> DataFrame:
    rows = entities(spark, sf).select("entity_id", "source", "segment", "y")
    params = rows.filter("segment <> 'MACHINERY'").groupBy("source", "segment").agg(F.avg("y").alias("base"))
    out = A.with_params(rows, params.withColumn("known", F.lit(True)), ["source", "segment"], {"base": 170.0, "known": False})
    return out.select("entity_id", F.round("base", 4).alias("base"), "known")


GATE_GRID = [(float(t), s, b) for t in (155, 160, 165, 170) for s in (1.5, 3.0, 6.0) for b in (0.25, 0.5, 1.0)]


@query(
    "join_specs_rows",
    with_sql("one")
    + """, g AS (SELECT t::DOUBLE AS threshold, s::DOUBLE AS scale, b::DOUBLE AS blend FROM (VALUES (155), (160), (165), (170)) a(t), (VALUES (1.5), (3.0), (6.0)) c(s), (VALUES (0.25), (0.5), (1.0)) d(b))
       SELECT threshold, scale, blend, count(*) AS n, round(avg(abs(pred + blend / (1.0 + exp((pred - threshold) / scale)) * (155 - pred) - y)), 4) AS mae FROM one CROSS JOIN g GROUP BY 1, 2, 3""",
)
def specs(spark: SparkSession, sf: str) -> DataFrame:
    from rollcall.operators.ensemble import gated

    rows = A.specs_rows(one_candidate(spark, sf).select("y", "pred"), GATE_GRID, ("threshold", "scale", "blend"))
    mixed = gated(F.col("pred"), F.lit(155.0), F.col("threshold"), F.col("scale"), F.col("blend"))
    return rows.groupBy("threshold", "scale", "blend").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(mixed - F.col("y"))), 4).alias("mae")
    )


@query(
    "set_union_sources",
    """SELECT concat('S_', s_suppkey) AS entity_id, 'SUPPLIER' AS source, s_acctbal AS y, NULL::VARCHAR AS segment FROM supplier
       UNION ALL SELECT concat('C_', c_custkey), 'CUSTOMER', c_acctbal, c_mktsegment FROM customer""",
)
def union_sources(spark: SparkSession, sf: str) -> DataFrame:
    a = load(spark, sf, "supplier").select(
        F.concat(F.lit("S_"), F.col("s_suppkey").cast("string")).alias("entity_id"), F.lit("SUPPLIER").alias("source"), F.col("s_acctbal").alias("y")
    )
    b = load(spark, sf, "customer").select(
        F.concat(F.lit("C_"), F.col("c_custkey").cast("string")).alias("entity_id"), F.lit("CUSTOMER").alias("source"),
        F.col("c_acctbal").alias("y"), F.col("c_mktsegment").alias("segment"),
    )
    return S.union_sources([a, b])


@query(
    "set_union_support",
    with_sql("ent")
    + """SELECT concat('C_', entity_id) AS entity_id, CASE WHEN g = 1 THEN 'Male' ELSE 'Female' END AS label, y FROM ent WHERE split = 'train'
       UNION ALL SELECT concat('S_', s_suppkey), CASE s_suppkey % 3 WHEN 0 THEN 'Male' ELSE 'Female' END, s_acctbal FROM supplier WHERE s_suppkey % 4 IN (0, 1) AND s_suppkey % 3 < 2""",
)
def union_support(spark: SparkSession, sf: str) -> DataFrame:
    base = entities(spark, sf).filter("split = 'train'").select(
        F.concat(F.lit("C_"), F.col("entity_id").cast("string")).alias("entity_id"),
        F.when(F.col("g") == 1, "Male").otherwise("Female").alias("label"), "y",
    )
    key = F.col("s_suppkey")
    collected = load(spark, sf, "supplier").select(
        F.concat(F.lit("S_"), key.cast("string")).alias("entity_id"),
        words(key, "Male", "Female", "Other").alias("label"), F.col("s_acctbal").alias("y"),
        words(key, "development", " Train_Support_Only", "sealed_test", "x").alias("collection_role"),
    )
    return S.union_support(base, collected, ("entity_id", "label", "y"))


@query(
    "set_union_development",
    with_sql("ent") + "SELECT entity_id, source, y FROM ent WHERE split IN ('train', 'val')",
)
def union_development(spark: SparkSession, sf: str) -> DataFrame:
    rows = entities(spark, sf)
    train = rows.filter("split = 'train'").select("entity_id", "source", "y", "age")
    val = rows.filter("split = 'val'").select("entity_id", "source", "y", "weight")
    return S.union_development(train, val, ("entity_id", "y"))


@query("set_intersect", "SELECT DISTINCT c_custkey AS id FROM customer JOIN orders ON o_custkey = c_custkey")
def intersect(spark: SparkSession, sf: str) -> DataFrame:
    a = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    b = load(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    return S.shared_keys(a, b, "id")


@query("set_except", "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT doc_id FROM labels)")
def except_(spark: SparkSession, sf: str) -> DataFrame:
    a = load(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    b = load(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return S.missing_keys(a, b, "id")


@query(
    "set_distinct",
    with_sql("ent", "items")
    + "SELECT split, count(DISTINCT entity_id) AS n_unique, count(*) AS n_rows FROM items JOIN ent USING (entity_id) GROUP BY ROLLUP (split)",
)
def distinct(spark: SparkSession, sf: str) -> DataFrame:
    rows = lookup_join(items(spark, sf).select("entity_id"), entities(spark, sf).select("entity_id", "split"), ["entity_id"], "inner")
    return S.unique_counts(rows, "entity_id", "split")
