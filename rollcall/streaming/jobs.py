"""Structured Streaming jobs: metric monitor, item intake, windowed drift.

Sinks are written per micro-batch under the batch number, so a restarted batch
replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rollcall.functions.quality import first_reason
from rollcall.session import settle


def batch_writer(path: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, number: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest_per_key(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Update-mode output read back: the last batch that spoke about a key wins."""
    table = spark.read.parquet(path)
    rest = [c for c in table.columns if c not in (*keys, "batch")]
    last = table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return last.select(*keys, "_r.*")


def metric_monitor(
    spark: SparkSession, source: str, schema: T.StructType, run: str, order: str, metric: Column, target: float, out: str, checkpoint: str
) -> StreamingQuery:
    """Latest, best and target-reached per run over an appended JSON-lines folder."""
    log = spark.readStream.schema(schema).option("allowNonNumericNumbers", True).json(source)
    value = F.nanvl(metric, F.lit(None).cast("double"))
    rows = log.filter(F.col(run).isNotNull()).select(run, order, value.alias("_m"))
    state = rows.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_steps"), F.max_by("_m", order).alias("latest"), F.min("_m").alias("best"),
        F.coalesce(F.max((F.col("_m") <= target).cast("int")) == 1, F.lit(False)).alias("reached"),
    )
    return (
        state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch_writer(out)).start()
    )


def item_intake(
    items: DataFrame, key: str, ts: str, delay: str, rules: Mapping[str, Column], digest: Column, out: str, checkpoint: str
) -> StreamingQuery:
    """Quality rules, then one accepted item per content; one write per batch, by verdict.

    Repeats are recognised within the watermark; an item later than the
    watermark is dropped, which the batch form does not do.  Rejected items pass by the
    deduplication, so its state holds accepted contents alone, each for ``delay``.
    """
    judged = items.withColumn("reason", first_reason(rules)).withColumn("_once", digest).withWatermark(ts, delay)
    accepted = judged.filter(F.col("reason").isNull()).dropDuplicatesWithinWatermark(["_once"])
    rejected = judged.filter(F.col("reason").isNotNull())
    both = accepted.withColumn("verdict", F.lit("accepted")).unionByName(rejected.withColumn("verdict", F.lit("rejected"))).drop("_once")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("verdict").parquet(f"{out}/batch={number}")

    return both.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def drift_windows(
    rows: DataFrame, ts: str, window: str, delay: str, feature: str, value: str, reference: DataFrame, out: str, checkpoint: str
) -> StreamingQuery:
    """Mean shift per time window and feature against a static reference (feature, mean, std), computed once."""
    reference = settle(reference)
    state = rows.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w"), feature).agg(
        F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")
    )
    return (
        state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(batch_writer(out, lambda batch: window_shift(batch, feature, reference))).start()
    )


def window_shift(windows: DataFrame, feature: str, reference: DataFrame) -> DataFrame:
    ref = reference.select(feature, F.col("mean").alias("reference_mean"), F.col("std").alias("_s"))
    shift = F.abs(F.col("mean") - F.col("reference_mean"))
    scale = F.when(F.abs("_s") > 1e-9, F.abs("_s")).otherwise(F.lit(1.0))
    return windows.join(ref, feature).select(
        F.col("w.start").alias("start"), feature, "n", "mean", shift.alias("abs_shift"), (shift / scale).alias("std_units")
    )
