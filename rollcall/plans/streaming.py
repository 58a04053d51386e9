"""Queries that run a stream to its end and read its sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall import schema as SC
from rollcall.plans.profile import rounded
from rollcall.plans.registry import query
from rollcall.plans.sources import _LOG, metric_lines
from rollcall.plans.tables import load
from rollcall.session import new_path
from rollcall.streaming import jobs as J


@query(
    "strm_metric_monitor",
    f"WITH {_LOG} SELECT run, count(*) AS n_steps, arg_max_null(mae, epoch) AS latest, min(mae) AS best, coalesce(bool_or(mae <= 2.0), FALSE) AS reached FROM lg GROUP BY run",
)
def monitor(spark: SparkSession, sf: str) -> DataFrame:
    source, out, state = (new_path(spark, n) for n in ("log", "monitor", "state"))
    metric_lines(spark, sf).write.text(source)
    value = F.try_element_at("val", F.lit("mae"))
    J.metric_monitor(spark, source, SC.METRIC_LOG, "run", "epoch", value, 2.0, out, state).awaitTermination()
    return J.latest_per_key(spark, out, ["run"])


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a stream; the zone-less time becomes a timestamp so that it can carry a watermark."""
    batch = load(spark, sf, "events")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "strm_item_intake",
    """WITH e AS (SELECT event_id, concat(user_id, ':', event_type) AS content, CASE WHEN value < 1 THEN 'too_short' WHEN event_type = 'error' THEN 'bad_type' END AS reason FROM events)
       SELECT 'accepted' AS sink, NULL::VARCHAR AS reason, count(DISTINCT content) AS n, count(DISTINCT content) AS n_contents FROM e WHERE reason IS NULL
       UNION ALL SELECT 'rejected', reason, count(*), count(DISTINCT content) FROM e WHERE reason IS NOT NULL GROUP BY reason""",
)
def item_intake(spark: SparkSession, sf: str) -> DataFrame:
    out, state = new_path(spark, "intake"), new_path(spark, "state")
    content = F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("event_type"))
    rules = {"too_short": F.col("value") < 1, "bad_type": F.col("event_type") == "error"}
    stream = event_stream(spark, sf).withColumn("content", content)
    J.item_intake(stream, "event_id", "ts", "30 days", rules, F.md5("content"), out, state).awaitTermination()
    return spark.read.parquet(out).groupBy(F.col("verdict").alias("sink"), "reason").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("content").alias("n_contents")
    )


@query(
    "strm_drift_window",
    """WITH r AS (SELECT event_type AS feature, avg(value) AS m, stddev_pop(value) AS s FROM events WHERE user_id % 2 = 0 GROUP BY 1),
       w AS (SELECT date_trunc('day', ts) AS start, event_type AS feature, count(*) AS n, avg(value) AS mean FROM events WHERE user_id % 2 = 1 GROUP BY 1, 2)
       SELECT strftime(start, '%Y-%m-%d') AS start, feature, n, round(mean, 6) AS mean, round(abs(mean - m), 6) AS abs_shift, round(abs(mean - m) / s, 6) AS std_units FROM w JOIN r USING (feature)""",
)
def drift_window(spark: SparkSession, sf: str) -> DataFrame:
    out, state = new_path(spark, "drift"), new_path(spark, "state")
    reference = load(spark, sf, "events").filter("user_id % 2 = 0").groupBy(F.col("event_type").alias("feature")).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )
    rows = event_stream(spark, sf).filter("user_id % 2 = 1").withColumnRenamed("event_type", "feature")
    J.drift_windows(rows, "ts", "1 day", "2 days", "feature", "value", reference, out, state).awaitTermination()
    table = J.latest_per_key(spark, out, ["start", "feature"])
    return rounded(table.withColumn("start", F.date_format("start", "yyyy-MM-dd")), 6)
