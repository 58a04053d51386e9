"""Queries for sources, sinks and content jobs.

Text and file inputs are first written by Spark from the given tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall import schema as SC
from rollcall.functions import numbers as N
from rollcall.operators import jobs as J
from rollcall.operators import metrics as M
from rollcall.operators.frames import once_per_input
from rollcall.operators.grouped import lookup_join
from rollcall.operators.rules import item_rules, with_all_reasons, with_reason
from rollcall.plans.audit import split_documents, _DOCS
from rollcall.plans.ensemble import NAMES
from rollcall.plans.frames import vectors
from rollcall.plans.metrics import METRICS
from rollcall.plans.profile import rounded
from rollcall.plans.registry import query
from rollcall.plans.rules import _MANIFEST, _MEASURED, manifest, measured, qc_rules
from rollcall.plans.scalars import words, words_sql
from rollcall.plans.tables import entities, items, load, predictions, with_sql
from rollcall.session import new_path
from rollcall.sources import readers as R
from rollcall.sources import sinks as S


@query(
    "src_manifest",
    with_sql("ent", more=_MANIFEST)
    + "SELECT entity_id::VARCHAR AS entity_id, source, label, height, nullif(weight, '') AS weight, nullif(age, '') AS age, audio_paths FROM man",
)
def src_manifest(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "manifest")
    S.write_csv(manifest(spark, sf), path, SC.MANIFEST_COLUMNS)
    return R.read_manifest(spark, path)


_PREFIXES = ("Hin", "Kan", "Mal", "Tam", "Tel", "Xyz")


@query(
    "src_master_list_a",
    f"""WITH c AS (SELECT c_custkey AS k, {words_sql('c_custkey', *_PREFIXES)} AS p FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 13 <> 0)
       SELECT concat('NISP_', p, '_', k) AS entity_id, 'NISP' AS source, {words_sql('k', 'Male', 'Female', 'Unknown')} AS label,
         CASE WHEN k % 19 <> 0 OR k % 17 = 0 THEN 150 + k % 50 + 0.5::DOUBLE END AS height, CASE WHEN k % 17 <> 0 THEN (40 + k % 70)::DOUBLE END AS weight,
         CASE WHEN k % 17 <> 0 THEN round_even(20 + k % 40 + (k % 10) / 10.0::DOUBLE, 0)::INT END AS age,
         CASE p WHEN 'Hin' THEN concat('Hindi_master/', k) WHEN 'Kan' THEN concat('Kannada_master/', k) WHEN 'Mal' THEN concat('Malayalam_master/', k)
           WHEN 'Tam' THEN concat('Tamil_master/', k) WHEN 'Tel' THEN concat('Telugu_master/', k) END AS folder,
         CASE WHEN k % 17 = 0 THEN 'too few fields' WHEN k % 19 = 0 THEN 'malformed number' WHEN p = 'Xyz' THEN 'unknown prefix' END AS reason FROM c""",
)
def master_a(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    text = lambda c: c.cast("string")
    height = F.when((key % 19 == 0) & (key % 17 != 0), F.lit("tall")).otherwise(F.concat(text(F.lit(150) + key % 50), F.lit(".5")))
    head = [F.concat(words(key, *_PREFIXES), F.lit("_"), text(key)), words(key, "Male", "f", "?"), F.lit("x"), height]
    tail = [F.lit("38.0"), F.lit("80.0"), text(F.lit(40) + key % 70), F.concat(text(F.lit(20) + key % 40), F.lit("."), text(key % 10)), F.lit("end")]
    line = F.when(key % 11 == 0, "").when(key % 13 == 0, "; note").when(key % 17 == 0, F.concat_ws("  ", *head)).otherwise(F.concat_ws("  ", *head, *tail))
    path = new_path(spark, "list-a")
    load(spark, sf, "customer").select(line.alias("value")).write.text(path)
    return R.read_master_list_a(spark, path)


@query(
    "src_master_list_b",
    """WITH c AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 9 <> 0)
       SELECT concat('TIMIT_', 'S', k) AS entity_id, 'TIMIT' AS source, CASE k % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'Unknown' END AS label,
         CASE WHEN k % 7 <> 0 THEN round_even((5 * 12 + k % 12) * 2.54::DOUBLE, 2) END AS height, NULL::DOUBLE AS weight,
         CASE WHEN k % 8 <> 0 THEN floor(date_diff('day', make_date(1940 + k % 30, 6, 17), DATE '1986-03-03') / 365)::INT END AS age,
         concat(CASE k % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'X' END, 'S', k) AS folder, CASE WHEN k % 7 = 0 THEN 'malformed height' END AS reason FROM c""",
)
def master_b(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    born = F.when(key % 8 == 0, "??/??/??").otherwise(F.concat(F.lit("06/17/"), text(F.lit(40) + key % 30)))
    height = F.when(key % 7 == 0, "tall").otherwise(F.concat(F.lit("5'"), text(key % 12), F.lit('"')))
    line = F.concat_ws(" ", F.concat(F.lit("s"), text(key)), words(key, "M", "f", "x"), F.lit("1"), F.lit("TRN"), F.lit("03/03/86"), born, height, F.lit("WHT"))
    path = new_path(spark, "list-b")
    load(spark, sf, "supplier").select(F.when(key % 9 == 0, ";c").otherwise(line).alias("value")).write.text(path)
    out = R.read_master_list_b(spark, path)
    return out.withColumn("entity_id", F.concat(F.lit("TIMIT_"), F.upper(F.substring("entity_id", 7, 100))))


#: order keys in one file
_BLOCK = 250


def order_files(spark: SparkSession, sf: str) -> str:
    """A folder with one text file for each block of order keys, lines in order of the keys."""
    path = new_path(spark, "orders")
    block = F.floor(F.col("o_orderkey") / _BLOCK).cast("int").alias("block")
    line = F.concat_ws(":", *[F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_orderstatus")])
    lines = load(spark, sf, "orders").select("o_orderkey", block, line.alias("value"))
    lines.repartition("block").sortWithinPartitions("block", "o_orderkey").select("block", "value").write.partitionBy("block").text(path)
    return path


def owner() -> Column:
    return F.regexp_extract("path", "block=([0-9]+)", 1).cast("int").alias("block")


_FILES = f"""WITH files AS (
    SELECT (o_orderkey // {_BLOCK})::INT AS block,
           string_agg(concat(o_orderkey, ':', o_custkey, ':', o_orderstatus, chr(10)), '' ORDER BY o_orderkey) AS body
    FROM orders GROUP BY 1)
"""


@query("src_file_listing", _FILES + "SELECT block, strlen(body)::BIGINT AS length FROM files")
def file_listing(spark: SparkSession, sf: str) -> DataFrame:
    return R.list_files(spark, order_files(spark, sf), ".TXT").select(owner(), "length")


@query("sink_integrity_manifest", _FILES + "SELECT block, sha256(body) AS sha256, strlen(body)::BIGINT AS bytes FROM files")
def integrity(spark: SparkSession, sf: str) -> DataFrame:
    return S.integrity_manifest(spark, order_files(spark, sf), ".txt").select(owner(), "sha256", "bytes")


@query("sink_integrity_inputs")
def integrity_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest of the given files themselves; a digest of Parquet files has no SQL form."""
    found = S.integrity_manifest(spark, sf, ".parquet")
    return found.select(F.substring_index("path", "/", -1).alias("name"), "sha256", "bytes")


@query(
    "src_item_features",
    with_sql("ent", "items")
    + """SELECT split, count(*) AS n, count(DISTINCT entity_id) AS n_entities, round(avg(CASE WHEN item_id % 10 = 0 THEN 0.5 ELSE quality END), 6) AS quality, 0.75::DOUBLE AS voiced,
         count(*) FILTER (WHERE drift IS NULL) AS no_drift, 0::BIGINT AS n_augmented FROM items JOIN ent USING (entity_id) WHERE split <> 'test' GROUP BY split""",
)
def item_store(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "items")
    rows = lookup_join(items(spark, sf), entities(spark, sf).select("entity_id", "split"), ["entity_id"], "inner")
    quality = F.when(F.col("item_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("quality"))
    S.write_guarded(rows.select("item_id", "entity_id", quality.alias("quality"), "speech", "snr", "drift", "split"), path, "refuse", ["split"])
    store = R.read_item_store(spark, path).filter("split <> 'test'")
    return store.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("entity_id").alias("n_entities"), F.round(F.avg("quality"), 6).alias("quality"),
        F.round(F.avg("voiced"), 6).alias("voiced"), F.count_if(F.col("drift").isNull()).alias("no_drift"), F.count_if("is_augmented").alias("n_augmented"),
    )


@query(
    "src_view_discovery",
    f"WITH {_DOCS} SELECT concat(source, '/', lang) AS view, count(*) AS n_rows FROM docs GROUP BY 1 HAVING count(DISTINCT split) = 3",
)
def view_discovery(spark: SparkSession, sf: str) -> DataFrame:
    rows = split_documents(spark, sf).select(F.concat_ws("/", "source", "lang").alias("view"), "split")
    return R.complete_views(rows, "view", "split")


def metric_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as metric log lines, some of them broken."""
    key = F.col("event_id")
    metric = F.when(key % 20 == 0, F.lit("NaN")).otherwise(F.col("value").cast("string"))
    good = F.concat(
        F.lit('{"run": '), F.col("user_id").cast("string"), F.lit(', "epoch": '), key.cast("string"), F.lit(', "val": {"mae": '), metric,
        F.lit('}, "monitor_name": "mae", "lr": 0.001}'),
    )
    line = F.when(key % 31 == 0, "").when(key % 29 == 0, '{"run": 1, "epoch"').when(key % 23 == 0, "[1, 2]").otherwise(good)
    return load(spark, sf, "events").select(line.alias("value"))


_LOG = "lg AS (SELECT user_id AS run, event_id AS epoch, CASE WHEN event_id % 20 <> 0 THEN value END AS mae FROM events WHERE event_id % 31 <> 0 AND event_id % 29 <> 0 AND event_id % 23 <> 0)"


@query("src_jsonl_metrics", f"WITH {_LOG} SELECT run, epoch, mae FROM lg QUALIFY row_number() OVER (PARTITION BY run ORDER BY epoch DESC) <= 5")
def jsonl(spark: SparkSession, sf: str) -> DataFrame:
    from rollcall.operators.grouped import first_n

    path = new_path(spark, "log")
    metric_lines(spark, sf).write.text(path)
    log = R.read_metric_log(spark, path).filter("run IS NOT NULL")
    rows = log.select("run", "epoch", N.finite(F.try_element_at("val", F.lit("mae"))).alias("mae"))
    return first_n(rows, ["run"], [F.desc("epoch")], 5)


@query(
    "sink_split_bundle",
    with_sql("ent")
    + """SELECT split, count(*) AS n_rows, sum(('0x' || substr(sha256(to_json({'entity_id': entity_id, 'segment': segment})::VARCHAR), 1, 8))::BIGINT)::VARCHAR AS hash_sum_0, count(*) AS n_written FROM ent GROUP BY split""",
)
def split_bundle(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "splits")
    prints = S.write_split_bundle(entities(spark, sf), path, "split", ("train", "val", "test"), ("entity_id", "segment"))
    written = spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n_written"))
    return prints.select("split", "n_rows", "hash_sum_0").join(written, "split")


@query(
    "sink_accept_reject",
    with_sql("items", more=_MEASURED)
    + """, n AS (SELECT entity_id, count(*) FILTER (WHERE len(f) = 0) AS k FROM qc GROUP BY 1)
       SELECT 'accepted_entities' AS sink, count(*) FILTER (WHERE k >= 1) AS n FROM n UNION ALL SELECT 'rejected_entities', count(*) FILTER (WHERE k < 1) FROM n
       UNION ALL SELECT 'accepted_items', count(*) FILTER (WHERE len(f) = 0) FROM qc UNION ALL SELECT 'rejected_items', count(*) FILTER (WHERE len(f) > 0) FROM qc""",
)
def accept_reject(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_reason(measured(spark, sf), qc_rules())
    per = rows.groupBy("entity_id").agg(F.count_if(F.col("reason").isNull()).alias("n_ok"))
    per = per.withColumn("reason", F.when(F.col("n_ok") < 1, "too_few_valid_items"))
    path = new_path(spark, "decision")
    targets = S.write_accept_reject(per, rows, path, columns={"items": ("item_id", "entity_id", "duration")})
    out = None
    for target in targets:
        row = spark.read.parquet(target).agg(F.count(F.lit(1)).alias("n")).select(F.lit(target.rsplit("/", 1)[1]).alias("sink"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "sink_predictions",
    with_sql("preds")
    + "SELECT entity_id, split, round(any_value(y), 8) AS y, "
    + ", ".join(f"round(max(pred) FILTER (WHERE candidate = '{n}'), 8) AS {n}, round(abs(max(pred) FILTER (WHERE candidate = '{n}') - any_value(y)), 8) AS abs_err_{n}" for n in NAMES)
    + " FROM preds GROUP BY 1, 2",
)
def predictions_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "predictions")
    table = S.predictions_wide(predictions(spark, sf), ("entity_id", "split"), "y", "candidate", "pred", NAMES)
    table.write.mode("errorifexists").parquet(path)
    return rounded(spark.read.parquet(path))


@query("sink_report", with_sql("preds") + f"SELECT candidate, {METRICS} FROM preds GROUP BY 1")
def report(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "report")
    table = rounded(M.regression_metrics(predictions(spark, sf), ["candidate"], "y", "pred"), 6)
    S.write_report({"candidates": table}, path)
    return spark.read.schema(table.schema).json(f"{path}/candidates")


@query("sink_resume_incremental", "SELECT 'first' AS run, count(*) FILTER (WHERE doc_id % 3 = 0) AS n, count(DISTINCT doc_id) FILTER (WHERE doc_id % 3 = 0) AS n_unique FROM documents UNION ALL SELECT 'second', count(*), count(*) FROM documents UNION ALL SELECT 'third', count(*), count(*) FROM documents")
def resume(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "features")
    docs = load(spark, sf, "documents").select("doc_id", "text")
    compute = lambda todo: todo.select("doc_id", F.sha2("text", 256).alias("digest"))
    out = None
    for name, wanted in (("first", docs.filter("doc_id % 3 = 0")), ("second", docs), ("third", docs)):
        table = S.resume(spark, wanted, path, ["doc_id"], compute)
        row = table.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_unique")).collect()[0]
        part = table.limit(1).select(F.lit(name).alias("run"), F.lit(row["n"]).cast("long").alias("n"), F.lit(row["n_unique"]).cast("long").alias("n_unique"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "sink_overwrite_guard",
    """SELECT * FROM (SELECT 'refuse' AS policy, FALSE AS written, count(*) AS n_after FROM nation UNION ALL SELECT 'resume', TRUE, 2 * count(*) FROM nation UNION ALL SELECT 'overwrite', TRUE, count(*) FROM nation)""",
)
def overwrite_guard(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "guarded")
    table = load(spark, sf, "nation")
    S.write_guarded(table, path, "refuse")
    out = None
    for policy in S.POLICIES:
        try:
            S.write_guarded(table, path, policy)
            written = True
        except Exception as exc:  # noqa: BLE001
            if "PATH_ALREADY_EXISTS" not in str(exc):
                raise
            written = False
        n = spark.read.parquet(path).count()
        row = table.limit(1).select(F.lit(policy).alias("policy"), F.lit(written).alias("written"), F.lit(n).cast("long").alias("n_after"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "src_dedup_compute_cache",
    "SELECT doc_id, sha256(concat(source, ':', lang)) AS value, length(concat(source, ':', lang)) AS n FROM documents",
)
def compute_cache(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "documents").select("doc_id", F.concat_ws(":", "source", "lang").alias("path"))
    once = lambda d: d.select("path", F.sha2("path", 256).alias("value"), F.length("path").cast("long").alias("n"))
    return once_per_input(rows, ["path"], once).select("doc_id", "value", "n")


@query(
    "job_content_hash",
    "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, strlen(text) AS bytes FROM documents",
)
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return J.content_hash(load(spark, sf, "documents"), "doc_id", "text")


def recordings(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as sampled items: 16-bit levels, some silent, some short, some at a low rate."""
    key = F.col("vec_id")
    level = F.when(key % 5 == 0, 0.0).otherwise(F.lit(60000.0))
    whole = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    return vectors(spark, sf).select(
        F.concat(F.lit("rec/"), key.cast("string"), F.lit(".wav")).alias("path"),
        F.transform("v", lambda x: F.greatest(F.least(whole(x * level), F.lit(32767)), F.lit(-32768)) / F.lit(32768.0)).alias("samples"),
        F.when(key % 7 == 0, 4000).otherwise(8000).alias("rate"),
        F.lit(1).alias("channels"),
        (F.size("v") * F.when(key % 6 == 0, 100).otherwise(300)).alias("n_frames"),
    )


@query(
    "job_pcm_qc",
    """WITH s AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 0.0::DOUBLE ELSE greatest(least(trunc(x * 60000.0::DOUBLE), 32767), -32768) / 32768.0::DOUBLE END AS v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings)),
       m AS (SELECT vec_id, 64 * CASE WHEN vec_id % 6 = 0 THEN 100 ELSE 300 END / CASE WHEN vec_id % 7 = 0 THEN 4000.0::DOUBLE ELSE 8000 END AS duration, CASE WHEN vec_id % 7 = 0 THEN 4000 ELSE 8000 END AS rate,
         20 * log10(greatest(sqrt(avg(v * v)), 1e-12)) AS rms, max(abs(v)) AS peak, avg((abs(v) >= 0.999)::INT) AS clipping FROM s GROUP BY vec_id)
       SELECT concat('rec/', vec_id, '.wav') AS path, duration, rate, round(rms, 6) AS rms, round(peak, 6) AS peak, round(clipping, 6) AS clipping,
         array_to_string(list_filter([CASE WHEN rate < 8000 THEN 'sample_rate_too_low' END, CASE WHEN duration < 2 THEN 'too_short' END, CASE WHEN duration > 30 THEN 'too_long' END, CASE WHEN rms < -50 THEN 'near_silent' END,
           CASE WHEN rms > -3 THEN 'excessive_level' END, CASE WHEN peak < 0.01 THEN 'low_peak' END, CASE WHEN clipping > 0.01 THEN 'clipped' END], lambda x: x IS NOT NULL), '|') AS qc_reasons FROM m""",
)
def pcm(spark: SparkSession, sf: str) -> DataFrame:
    rows = recordings(spark, sf).withColumns(J.level_stats(F.col("samples"), F.col("n_frames"), F.col("rate")))
    rules = item_rules(*[F.col(c) for c in ("channels", "rate", "duration", "rms", "peak", "clipping")])
    judged = with_all_reasons(rows, rules, "why")
    return judged.select(
        "path", "duration", "rate", F.round("rms", 6).alias("rms"), F.round("peak", 6).alias("peak"), F.round("clipping", 6).alias("clipping"), F.array_join("why", "|").alias("qc_reasons")
    )


@query(
    "job_content_normalise_plan",
    with_sql("items", more=_MEASURED)
    + """SELECT item_id, rate <> 16000 AS resample, channels > 1 AS downmix, round(0.1::DOUBLE / pow(10.0::DOUBLE, rms / 20.0), 6) AS gain,
         coalesce(peak * 0.1::DOUBLE / pow(10.0::DOUBLE, rms / 20.0) > 1, FALSE) AS clips_after_gain FROM meas""",
)
def normalise(spark: SparkSession, sf: str) -> DataFrame:
    out = J.normalise_plan(measured(spark, sf), F.col("rate"), F.col("channels"), F.col("rms"), F.col("peak"))
    gain = F.when(F.col("rms").isNotNull(), F.round("gain", 6))
    return out.select("item_id", "resample", "downmix", gain.alias("gain"), "clips_after_gain")
