"""Profiles of tables: summaries, distributions, drift, diagnostics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.hashing import hash_order
from rollcall.operators.grouped import attach, group_quantiles, lookup_join, measured, running, same_keys


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Long form, NULLs left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    out = df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, f"_p.{name}", f"_p.{value}")
    return out.filter(F.col(value).isNotNull())


def split_summary(df: DataFrame, split: str, key: str, dims: Mapping[str, Column]) -> DataFrame:
    """Rows and unique entities per split, overall and per value of each dimension."""
    pairs = F.array(
        *[F.struct(F.lit(d).alias("dim"), F.coalesce(c.cast("string"), F.lit("UNKNOWN")).alias("val")) for d, c in {"all": F.lit("all"), **dims}.items()]
    )
    long = df.select(split, key, F.explode(pairs).alias("_p")).select(split, key, "_p.dim", "_p.val")
    return long.groupBy(split, "dim", "val").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_unique"))


def describe(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """n, min, max, mean, median, quartiles, sample sd, skew per metric.

    Skew is the mean of cubed z-scores under the sample sd, from a second pass
    around the mean, with a label for its direction.
    """
    by = [*keys, "metric"]
    long = unpivot(df, keys, columns)
    long, known = measured(long, by)
    centred = attach(long, by, {"_mean": F.avg("value"), "_std": F.stddev_samp("value")}, known)
    z = (F.col("value") - F.col("_mean")) / F.nullif(F.col("_std"), F.lit(0.0))
    aggs = {
        "n": F.count(F.lit(1)), "min": F.min("value"), "max": F.max("value"), "mean": F.max("_mean"), "std": F.coalesce(F.max("_std"), F.lit(0.0)),
        "skew": F.coalesce(F.avg(z * z * z), F.lit(0.0)),
    }
    out = group_quantiles(centred, by, "value", {"median": 0.5, "p25": 0.25, "p75": 0.75}, aggs=aggs, known=known)
    side = F.when(F.col("skew") > 0.5, "right").when(F.col("skew") < -0.5, "left").otherwise("symmetric")
    return out.withColumn("skew_label", side)


def histogram(df: DataFrame, column: str, bins: int, keys: Sequence[str] = (), width: int = 48) -> DataFrame:
    """Equal-width bins from min to max, last bin closed, empty bins kept, bar lengths."""
    data = df.select(*keys, F.col(column).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    limits = data.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    place = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("_v") - F.col("_lo")) / F.nullif(step, F.lit(0.0))), F.lit(bins - 1))
    )
    if keys:
        placed = lookup_join(data, limits, keys)
    else:
        placed = data.withColumns({c: limits.select(c).scalar() for c in ("_lo", "_hi")})
    counts = placed.withColumn("bin", place.cast("int")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    frame = limits.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = same_keys(frame, counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    top = out.groupBy(*keys).agg(F.max("n").alias("_top"))
    if keys:
        out = same_keys(out, top, keys, "left")
    else:
        out = out.withColumn("_top", top.select("_top").scalar())
    return out.select(
        *keys, "bin",
        (F.col("_lo") + F.col("bin") * step).alias("lo"),
        (F.col("_lo") + (F.col("bin") + 1) * step).alias("hi"),
        "n",
        F.floor(F.col("n") / F.col("_top") * width).cast("long").alias("bar"),
    )


def imbalance(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """1 - evenness of the category counts; 1 with at most one category."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("c"))
    # entropy = ln N - sum(c ln c) / N, so no second pass for the total is needed
    n, total = F.count(F.lit(1)), F.sum("c")
    entropy = F.ln(total) - F.sum(F.col("c") * F.ln("c")) / total
    score = F.when(n <= 1, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - entropy / F.ln(n)))
    return counts.groupBy(*keys).agg(n.alias("n_classes"), score.alias("imbalance"))


def pearson(df: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str] = ()) -> DataFrame:
    """Correlation over rows where both values are present."""
    rows = F.array(
        *[F.struct(F.lit(f"{a}~{b}").alias("pair"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")) for a, b in pairs]
    )
    long = df.select(*keys, F.explode(rows).alias("_p")).select(*keys, "_p.*").filter("a IS NOT NULL AND b IS NOT NULL")
    varies = (F.stddev_pop("a") > 1e-12) & (F.stddev_pop("b") > 1e-12)
    return long.groupBy(*keys, "pair").agg(F.count(F.lit(1)).alias("n"), F.when(varies, F.corr("a", "b")).alias("r"))


def ks(
    df: DataFrame, keys: Sequence[str], value: str, split: str, pairs: Sequence[tuple[str, str]]
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov D per group and pair of splits.

    Values are counted per split first; the cumulative counts run over distinct
    values only and use the sliced running sum for large groups.
    """
    names = sorted({s for pair in pairs for s in pair})
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(*[F.count_if(F.col(split) == s).alias(f"_n_{s}") for s in names])
    )
    known = counts.count()
    cum = running(counts, keys, [value], {f"_c_{s}": ("sum", F.col(f"_n_{s}")) for s in names}, known)
    cum = attach(cum, keys, {f"_t_{s}": F.sum(f"_n_{s}") for s in names}, known)
    part = lambda s: F.col(f"_c_{s}") / F.nullif(F.col(f"_t_{s}"), F.lit(0))
    wide = cum.groupBy(*keys).agg(*[F.max(F.abs(part(a) - part(b))).alias(f"{a}_{b}") for a, b in pairs])
    long = F.array(*[F.struct(F.lit(f"{a}_{b}").alias("pair"), F.col(f"{a}_{b}").alias("d")) for a, b in pairs])
    return wide.select(*keys, F.explode(long).alias("_p")).select(*keys, "_p.pair", "_p.d")


def item_counts(df: DataFrame, entity: str, source: str) -> DataFrame:
    """Items per entity: min, max, mean by source and overall (source NULL)."""
    per = df.groupBy(source, entity).agg(F.count(F.lit(1)).alias("n"))
    return per.rollup(source).agg(
        F.count(F.lit(1)).alias("n_entities"), F.min("n").alias("min_items"), F.max("n").alias("max_items"), F.avg("n").alias("mean_items")
    )


def readiness(
    size: Column, group_imbalance: Column, source_imbalance: Column, mean_ks: Column, mean_items: Column, outliers: Column
) -> dict[str, Column]:
    """Six scores in [0, 1] and their mean in per cent (95 and more counts as 100)."""
    one = F.lit(1.0)
    scores = {
        "size": F.least(size / 800.0, one),
        "group_balance": F.least(one, 1.0 - group_imbalance + 0.1),
        "source_balance": F.least(one, 1.0 - source_imbalance + 0.1),
        "split_consistency": F.greatest(F.lit(0.0), 1.0 - mean_ks * 0.35),
        "richness": F.least(mean_items / 35.0, one),
        "cleanliness": F.greatest(F.lit(0.0), 1.0 - outliers / (size * 3.0)),
    }
    overall = sum(scores.values(), F.lit(0.0)) / len(scores) * 100.0
    return {**scores, "overall": F.when(overall >= 95.0, F.lit(100.0)).otherwise(overall)}


def target_stats(df: DataFrame, targets: Mapping[str, Column], train: Column) -> DataFrame:
    """Mean and population sd (+1e-9) per target over train rows; 0 and 1 without any."""
    pairs = F.array(*[F.struct(F.lit(n).alias("target"), c.cast("double").alias("v")) for n, c in targets.items()])
    long = df.filter(train).select(F.explode(pairs).alias("_p")).select("_p.*")
    return long.groupBy("target").agg(
        F.count("v").alias("n"), F.coalesce(F.avg("v"), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop("v") + 1e-9, F.lit(1.0)).alias("std")
    )


def scalar_summary(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """count, mean, population sd, min, max per feature."""
    return unpivot(df, keys, columns, "feature").groupBy(*keys, "feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )


def validity_counts(df: DataFrame, keys: Sequence[str], entity: str, checks: Mapping[str, Column]) -> DataFrame:
    """Rows, entities and one counter per check, in one aggregation."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(entity).alias("n_entities"),
        *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()],
    )


def dim_variance(df: DataFrame, vector: str) -> DataFrame:
    """Population variance per vector entry."""
    return df.select(F.posexplode(vector).alias("dim", "v")).groupBy("dim").agg(F.var_pop("v").alias("variance"), F.count("v").alias("n"))


def zero_variance(df: DataFrame, vector: str, eps: float = 1e-12) -> DataFrame:
    return dim_variance(df, vector).filter(F.coalesce(F.col("variance"), F.lit(0.0)) <= eps).select("dim")


def keep_observed(df: DataFrame, vector: str) -> DataFrame:
    """Drop vector entries that are missing in every row.

    The flags come back as one array whose length is the vector width.
    """
    seen = df.select(F.posexplode(vector).alias("dim", "v")).groupBy("dim").agg(F.max(F.col("v").isNotNull()).alias("seen"))
    flags = seen.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "seen"))), lambda x: x["seen"]).alias("flags"))
    flagged = df.withColumn("_flags", flags.select("flags").scalar())
    return flagged.withColumn(vector, F.filter(vector, lambda x, i: F.get("_flags", i))).drop("_flags")


def drift(summary: DataFrame, split: str, reference: str = "train") -> DataFrame:
    """Shift of every feature mean from the reference split, also in its sd."""
    ref = summary.filter(F.col(split) == reference).select("feature", F.col("mean").alias("reference_mean"), F.col("std").alias("_s"))
    other = summary.filter(F.col(split) != reference).select(split, "feature", F.col("mean").alias("other_mean"))
    joined = other.join(ref, "feature").filter("reference_mean IS NOT NULL AND other_mean IS NOT NULL")
    shift = F.abs(F.col("other_mean") - F.col("reference_mean"))
    scale = F.when(F.abs("_s") > 1e-9, F.abs("_s")).otherwise(F.lit(1.0))
    return joined.select(
        split, "feature", "reference_mean", "other_mean", shift.alias("abs_shift"), (shift / scale).alias("std_units")
    )


def entity_features(df: DataFrame, entity: str, columns: Sequence[str], weight: str) -> DataFrame:
    """Item values per entity: weighted mean, median, sd, p10, p90 (long form).

    Weights are renormalised over the values that are present.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(entity, F.col(weight).alias("_w"), F.explode(pairs).alias("_p")).select(entity, "_w", "_p.*")
    long = long.filter(F.col("value").isNotNull())
    by = [entity, "feature"]
    aggs = {"mean": F.sum(F.col("_w") * F.col("value")) / F.sum("_w"), "std": F.stddev_pop("value")}
    return group_quantiles(long, by, "value", {"median": 0.5, "p10": 0.1, "p90": 0.9}, aggs=aggs)


def entity_weights(df: DataFrame, entity: str, weight: str) -> DataFrame:
    """Item count and weight summary per entity."""
    return df.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_items"), F.avg(weight).alias("w_mean"), F.stddev_pop(weight).alias("w_std"),
        F.min(weight).alias("w_min"), F.max(weight).alias("w_max"),
    )


def entity_embedding(df: DataFrame, entity: str, vector: str, wanted: DataFrame) -> DataFrame:
    """Mean and sd per vector entry for the wanted entities, with log1p of the item count."""
    rows = df.join(wanted.select(entity).distinct(), entity, "left_semi")
    dims = rows.select(entity, F.posexplode(vector).alias("dim", "v")).groupBy(entity, "dim").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count(F.lit(1)).alias("n")
    )
    return dims.withColumn("log_n", F.log1p(F.col("n").cast("double"))).drop("n")


def run_stats(df: DataFrame, source: str) -> DataFrame:
    """Processing counts and mean durations by source and overall (source NULL)."""
    return df.rollup(source).agg(
        F.count(F.lit(1)).alias("processed"), F.count_if("dropped").alias("dropped"), F.count_if("truncated").alias("truncated"),
        F.count_if("flagged").alias("flagged"), F.avg("duration").alias("mean_before"),
        F.avg(F.when(~F.col("dropped"), F.col("clean"))).alias("mean_final"),
    )


def probe_audit(items: DataFrame, entity: str, key: str, listing: DataFrame, n_entities: int, seed: int = 42) -> DataFrame:
    """Spot check of sampled entities: missing items, formats, durations, peaks, advice."""
    sample = items.select(entity).distinct().orderBy(hash_order(seed, F.col(entity).cast("string")), entity).limit(n_entities)
    probed = items.select(entity, key).join(F.broadcast(sample) if n_entities <= 10_000 else sample, entity, "left_semi")
    joined = probed.join(listing, key, "left")
    found = F.col("rate").isNotNull()
    out = joined.agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if(~found).alias("n_missing"),
        F.count_distinct("rate").alias("n_rates"), F.max("rate").alias("max_rate"), F.max("channels").alias("max_channels"),
        F.min("duration").alias("min_duration"), F.max("duration").alias("max_duration"), F.avg("duration").alias("mean_duration"),
        F.min("peak").alias("min_peak"), F.max("peak").alias("max_peak"), F.avg("peak").alias("mean_peak"),
    )
    return out.withColumns({
        "resample": (F.col("n_rates") > 1) | ((F.col("n_rates") == 1) & (F.col("max_rate") != 16000)),
        "downmix": F.coalesce(F.col("max_channels") > 1, F.lit(False)),
        "drop_short": F.coalesce(F.col("min_duration") < 1.0, F.lit(False)),
        "normalise": F.coalesce((F.col("max_peak") > 0.99) | (F.col("min_peak") < 0.1), F.lit(False)),
    })


def quota(achieved: DataFrame, targets: Mapping[tuple[str, str], int], key: str = "entity_id") -> DataFrame:
    """Achieved, target and remaining entities per role and group (group ``all`` counts everyone)."""
    spark = achieved.sparkSession
    frame = spark.createDataFrame([(r, g, t) for (r, g), t in targets.items()], "role string, grp string, target long")
    rows = achieved.select("role", key, F.explode(F.array(F.lit("all"), "grp")).alias("grp"))
    counts = rows.groupBy("role", "grp").agg(F.count_distinct(key).alias("achieved"))
    out = same_keys(frame, counts, ["role", "grp"], "left").withColumn("achieved", F.coalesce("achieved", F.lit(0)).cast("long"))
    return out.withColumn("remaining", F.greatest(F.lit(0).cast("long"), F.col("target") - F.col("achieved")))
