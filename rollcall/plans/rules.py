"""Queries for filters and rule cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions import labels as L
from rollcall.functions.numbers import safe_number
from rollcall.operators import rules as R
from rollcall.operators.metrics import finite_candidates
from rollcall.plans.frames import vectors
from rollcall.plans.registry import query
from rollcall.plans.scalars import words, words_sql
from rollcall.plans.tables import entities, items, load, predictions, with_sql


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Entities as a raw text manifest with damaged cells and path lists."""
    key = F.col("entity_id")
    age = F.when(key % 17 == 0, "").when(key % 19 == 0, "n/a").otherwise((key % 90).cast("string"))
    height = F.when(key % 31 == 0, F.lit(None).cast("string")).otherwise((F.lit(130) + key % 90).cast("string"))
    weight = F.when(F.col("weight").isNull(), "").otherwise((F.lit(30) + key % 95).cast("string"))
    paths = F.transform(
        F.sequence(F.lit(0), (key % 9).cast("int")),
        lambda i: F.when(i == 1, "p/SA1.WAV").otherwise(
            F.concat(F.lit("p/Hin_"), key.cast("string"), F.lit("_Eng_"), words(key, "m", "f", "x"), F.lit("_"), i.cast("string"), F.lit(".wav"))
        ),
    )
    return entities(spark, sf).select(
        "entity_id", "source", F.when(F.col("g") == 1, "Male").otherwise("Female").alias("label"),
        age.alias("age"), height.alias("height"), weight.alias("weight"), F.array_join(paths, "|").alias("audio_paths"),
    )


_MANIFEST = f"""man AS (SELECT entity_id, source, CASE WHEN g = 1 THEN 'Male' ELSE 'Female' END AS label,
  CASE WHEN entity_id % 17 = 0 THEN '' WHEN entity_id % 19 = 0 THEN 'n/a' ELSE (entity_id % 90)::VARCHAR END AS age,
  CASE WHEN entity_id % 31 = 0 THEN NULL ELSE (130 + entity_id % 90)::VARCHAR END AS height,
  CASE WHEN weight IS NULL THEN '' ELSE (30 + entity_id % 95)::VARCHAR END AS weight,
  array_to_string(list_transform(range(0, entity_id % 9 + 1), lambda i: CASE WHEN i = 1 THEN 'p/SA1.WAV' ELSE
    concat('p/Hin_', entity_id, '_Eng_', {words_sql('entity_id', 'm', 'f', 'x')}, '_', i, '.wav') END), '|') AS audio_paths FROM ent)"""


@query(
    "flt_rule_cascade",
    with_sql("ent", more=_MANIFEST)
    + """SELECT entity_id, reason, CASE WHEN reason IS NULL THEN round_even(TRY_CAST(age AS DOUBLE), 0)::INT END AS age, n AS n_paths FROM (
         SELECT *, CASE WHEN coalesce(age, '') = '' THEN 'missing age' WHEN TRY_CAST(age AS DOUBLE) IS NULL THEN 'non-numeric age'
           WHEN age::DOUBLE NOT BETWEEN 18 AND 75 THEN 'age out of range'
           WHEN coalesce(height, '') = '' THEN 'missing height' WHEN height::DOUBLE NOT BETWEEN 140 AND 210 THEN 'height out of range'
           WHEN weight <> '' AND weight::DOUBLE NOT BETWEEN 40 AND 115 THEN 'weight out of range'
           WHEN n < 5 THEN 'too few items' END AS reason FROM (
           SELECT *, len(list_filter(string_split(audio_paths, '|'), lambda x: NOT (source = 'ASIA' AND x = 'p/SA1.WAV')))::BIGINT AS n FROM man))""",
)
def cascade(spark: SparkSession, sf: str) -> DataFrame:
    paths = L.split_list(F.col("audio_paths"))
    kept = F.when(
        F.col("source") == "ASIA", F.filter(paths, lambda p: ~L.is_fixed_name(p, ("SA1.WAV", "SA2.WAV")))
    ).otherwise(paths)
    fields = (R.FieldRange("age", 18, 75), R.FieldRange("height", 140, 210), R.FieldRange("weight", 40, 115, required=False))
    rows = manifest(spark, sf).withColumn("n_paths", F.size(kept).cast("long"))
    rows = R.with_reason(rows, {**R.field_rules(fields), "too few items": F.col("n_paths") < 5})
    age = F.when(F.col("reason").isNull(), F.bround(safe_number(F.col("age"))).cast("int"))
    return rows.select("entity_id", "reason", age.alias("age"), "n_paths")


@query(
    "flt_warn_mismatch",
    with_sql("ent", more=_MANIFEST)
    + """SELECT entity_id, d <> 'Unknown' AND d <> label AS mismatch FROM (SELECT entity_id, label,
         CASE entity_id % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'Unknown' END AS d FROM man)""",
)
def mismatch(spark: SparkSession, sf: str) -> DataFrame:
    derived = L.plain_label(L.name_part(F.get(L.split_list(F.col("audio_paths")), F.lit(0)), 3))
    return manifest(spark, sf).select(
        "entity_id", ((derived != "Unknown") & (derived != F.col("label"))).alias("mismatch")
    )


@query(
    "flt_zscore",
    with_sql("ent")
    + """, st AS (SELECT avg(y) AS my, stddev_samp(y) AS sy, avg(age) AS ma, stddev_samp(age) AS sa, avg(weight) AS mw, stddev_samp(weight) AS sw FROM ent)
       SELECT entity_id, CASE WHEN abs((y - my) / sy) > 1.6 THEN 'y' WHEN abs((age - ma) / sa) > 1.6 THEN 'age' WHEN abs((weight - mw) / sw) > 1.6 THEN 'weight' END AS reason
       FROM ent CROSS JOIN st""",
)
def zscore(spark: SparkSession, sf: str) -> DataFrame:
    rows = entities(spark, sf).select("entity_id", "y", "age", "weight")
    return R.zscore_reasons(rows, ("y", "age", "weight"), 1.6).select("entity_id", "reason")


_SUPPORT_LABELS = ("male", "F", "other", "woman")


@query(
    "flt_public_support",
    with_sql("ent")
    + f"""SELECT entity_id, CASE WHEN entity_id % 23 = 0 THEN 'rejected' WHEN NOT ok THEN 'skipped' WHEN entity_id % 4 = 2 THEN 'rejected' ELSE 'accepted' END AS status,
         CASE WHEN entity_id % 23 = 0 THEN 'missing_entity_id' WHEN ok AND entity_id % 4 = 2 THEN 'unsupported_label' END AS reason
       FROM (SELECT entity_id, coalesce(entity_id % 29 <> 0 AND y >= 145 AND y < 160, FALSE) AS ok FROM ent)""",
)
def support(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("entity_id")
    code = F.when(key % 23 == 0, " ").otherwise(key.cast("string"))
    y = F.when(key % 29 != 0, F.col("y"))
    label = L.intake_label(words(key, *_SUPPORT_LABELS))
    return R.support_status(entities(spark, sf), code, y, label, below=160.0, floor=145.0).select("entity_id", "status", "reason")


def intake(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("entity_id")
    first = F.lit(110) + key % 110
    return entities(spark, sf).select(
        "entity_id",
        F.when(key % 41 == 0, "").otherwise(F.concat(F.lit("P"), key.cast("string"))).alias("participant_code"),
        F.when(key % 37 == 0, F.lit(None)).otherwise((F.lit(12) + key % 60).cast("string")).alias("age_years"),
        first.cast("string").alias("height_measurement_1_cm"),
        F.when(key % 13 == 0, (first + 2).cast("string")).otherwise(F.concat(first.cast("string"), F.lit(".5"))).alias("height_measurement_2_cm"),
        words(key, "development", "sealed_test", "", None, " Development ", "train").alias("collection_role"),
        words(key, "yes", "Y", "1", "true", "yes", "yes", "no").alias("consent_audio_research"),
        words(key, "consented", "yes", "yes", "yes", "").alias("consent_model_training"),
    )


@query(
    "flt_consent_intake",
    with_sql("ent")
    + f"""SELECT entity_id, CASE WHEN reason IS NULL AND yy < 160 THEN yy END AS y,
         CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN yy >= 160 THEN 'skipped' ELSE 'accepted' END AS status, reason FROM (
         SELECT entity_id, (a + b) / 2 AS yy, CASE WHEN entity_id % 41 = 0 THEN 'missing_participant_code'
             WHEN entity_id % 37 = 0 OR 12 + entity_id % 60 < 18 THEN 'adult_participants_only'
             WHEN entity_id % 7 = 6 THEN 'audio_research_consent_missing' WHEN entity_id % 5 = 4 THEN 'model_training_consent_missing'
             WHEN NOT (a BETWEEN 120 AND 210 AND b BETWEEN 120 AND 210) THEN 'invalid_repeated_height'
             WHEN abs(a - b) > 1 THEN 'height_measurements_disagree_gt_1cm'
             WHEN entity_id % 6 = 5 THEN 'collection_role_must_be_development_or_sealed_test' END AS reason
         FROM (SELECT entity_id, (110 + entity_id % 110)::DOUBLE AS a, 110 + entity_id % 110 + CASE WHEN entity_id % 13 = 0 THEN 2.0::DOUBLE ELSE 0.5 END AS b FROM ent))""",
)
def consent(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.intake_status(R.require_pseudonymous(intake(spark, sf)), below=160.0)
    y = F.when(F.col("status") == "accepted", F.col("y"))
    return rows.select("entity_id", y.alias("y"), "status", "reason")


_CHECKED = ("region", "nation", "customer", "supplier", "part", "documents", "conversations")


@query(
    "flt_forbidden_columns",
    " UNION ALL ".join(
        f"SELECT '{t}' AS tbl, '{'name' if t in ('region', 'nation', 'customer', 'supplier', 'part') else ''}' AS found, count(*) AS n_rows FROM {t}"
        for t in _CHECKED
    ),
)
def forbidden(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name in _CHECKED:
        table = load(spark, sf, name)
        bare = [c.split("_", 1)[-1] if len(c.split("_", 1)[0]) == 1 else c for c in table.columns]
        row = table.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("tbl"), F.lit("|".join(R.forbidden_columns(bare))).alias("found"), "n_rows"
        )
        out = row if out is None else out.unionByName(row)
    return out


def measured(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("item_id")
    return items(spark, sf).select(
        "item_id", "entity_id", "day",
        (key % 4).cast("int").alias("channels"),
        (key % 5 * 4000).cast("int").alias("rate"),
        F.when(key % 53 != 0, key % 35).cast("double").alias("duration"),
        F.when(key % 47 != 0, -(key % 60)).cast("double").alias("rms"),
        (key % 50 / F.lit(1000.0)).alias("peak"),
        (key % 13 / F.lit(1000.0)).alias("clipping"),
    )


_MEASURED = """meas AS (SELECT item_id, entity_id, day, (item_id % 4)::INT AS channels, (item_id % 5 * 4000)::INT AS rate,
  CASE WHEN item_id % 53 <> 0 THEN (item_id % 35)::DOUBLE END AS dur, CASE WHEN item_id % 47 <> 0 THEN -(item_id % 60)::DOUBLE END AS rms,
  (item_id % 50) / 1000.0::DOUBLE AS peak, (item_id % 13) / 1000.0::DOUBLE AS clipping FROM items),
qc AS (SELECT item_id, entity_id, day, list_filter([CASE WHEN channels NOT IN (1, 2) THEN 'unsupported_channels' END, CASE WHEN rate < 8000 THEN 'sample_rate_too_low' END,
  CASE WHEN coalesce(dur < 2, TRUE) THEN 'too_short' END, CASE WHEN dur > 30 THEN 'too_long' END, CASE WHEN rms IS NULL THEN 'no_pcm_samples' END,
  CASE WHEN rms < -50 THEN 'near_silent' END, CASE WHEN rms > -3 THEN 'excessive_level' END, CASE WHEN peak < 0.01 THEN 'low_peak' END,
  CASE WHEN clipping > 0.01 THEN 'clipped' END], lambda x: x IS NOT NULL) AS f FROM meas)"""


def qc_rules() -> dict:
    return R.item_rules(*[F.col(c) for c in ("channels", "rate", "duration", "rms", "peak", "clipping")])


@query(
    "flt_item_qc_policy",
    with_sql("items", more=_MEASURED) + "SELECT item_id, len(f) = 0 AS qc_pass, array_to_string(f, '|') AS qc_reasons FROM qc",
)
def item_qc(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.with_all_reasons(measured(spark, sf), qc_rules(), "why")
    return rows.select("item_id", (F.size("why") == 0).alias("qc_pass"), F.array_join("why", "|").alias("qc_reasons"))


@query(
    "flt_min_items",
    with_sql("items", more=_MEASURED)
    + """, n AS (SELECT entity_id, count(*) FILTER (WHERE len(f) = 0) AS k FROM qc GROUP BY entity_id)
       SELECT item_id, CASE WHEN len(f) > 0 THEN f[1] WHEN k < 2 THEN 'entity_below_min_items' END AS reason FROM qc JOIN n USING (entity_id)""",
)
def min_items(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.with_reason(measured(spark, sf), qc_rules()).select("item_id", "entity_id", "reason")
    return R.min_items(rows, "entity_id", 2, "entity_below_min_items").select("item_id", "reason")


@query(
    "flt_observed_dims",
    """SELECT vec_id, 60::BIGINT AS kept, round(list_sum(list_filter(embedding::DOUBLE[], lambda x, i: i % 16 <> 0)), 6) AS total FROM embeddings""",
)
def observed(spark: SparkSession, sf: str) -> DataFrame:
    from rollcall.operators.profile import keep_observed

    holes = F.transform("v", lambda x, i: F.when((i + 1) % 16 != 0, x))
    out = keep_observed(vectors(spark, sf).select("vec_id", holes.alias("v")), "v")
    return out.select(
        "vec_id", F.size("v").cast("long").alias("kept"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total")
    )


@query(
    "flt_finite_predictions",
    with_sql("preds")
    + """SELECT candidate, count(*) AS n, count(*) FILTER (WHERE candidate = 'tree__deep' AND entity_id % 50 = 0) AS n_bad,
         candidate <> 'tree__deep' AS usable FROM preds GROUP BY candidate""",
)
def finite_preds(spark: SparkSession, sf: str) -> DataFrame:
    broken = (F.col("candidate") == "tree__deep") & (F.col("entity_id") % 50 == 0)
    rows = predictions(spark, sf).withColumn("pred", F.when(broken, F.lit(float("nan"))).otherwise(F.col("pred")))
    return finite_candidates(rows, "candidate", "pred")
