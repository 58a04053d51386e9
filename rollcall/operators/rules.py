"""Rule cascades: every row keeps the reason why it was accepted or not."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.labels import FORBIDDEN_COLUMNS, is_yes
from rollcall.functions.numbers import safe_number
from rollcall.functions.quality import first_reason, reasons
from rollcall.operators.grouped import attach


def last_wins(layers: Sequence[DataFrame], keys: Sequence[str], value: str, seq: str) -> DataFrame:
    """Merge key/value layers: later layers win, within a layer the highest ``seq``."""
    stacked = reduce(
        lambda a, b: a.unionByName(b),
        [df.select(*keys, value, seq).withColumn("_level", F.lit(i)) for i, df in enumerate(layers)],
    )
    return stacked.groupBy(*keys).agg(F.max_by(value, F.struct("_level", seq)).alias(value))


def with_reason(df: DataFrame, rules: Mapping[str, Column], name: str = "reason") -> DataFrame:
    """First failing rule, NULL for kept rows."""
    return df.withColumn(name, first_reason(rules))


def with_all_reasons(df: DataFrame, rules: Mapping[str, Column], name: str = "reasons") -> DataFrame:
    return df.withColumn(name, reasons(rules))


@dataclass(frozen=True)
class FieldRange:
    """Bounds of a text field that must hold a number."""

    column: str
    low: float
    high: float
    required: bool = True


def field_rules(fields: Sequence[FieldRange]) -> dict[str, Column]:
    """missing, non-numeric, range - per field, in order."""
    rules: dict[str, Column] = {}
    for f in fields:
        text = F.trim(F.coalesce(F.col(f.column), F.lit("")))
        number = safe_number(text)
        if f.required:
            rules[f"missing {f.column}"] = text == ""
        rules[f"non-numeric {f.column}"] = (text != "") & number.isNull()
        rules[f"{f.column} out of range"] = (number < f.low) | (number > f.high)
    return rules


def zscore_reasons(df: DataFrame, columns: Sequence[str], limit: float, name: str = "reason") -> DataFrame:
    """First column more than ``limit`` sample sd from its mean; statistics are taken once."""
    aggs = [F.avg(c).alias(f"m_{c}") for c in columns] + [F.stddev_samp(c).alias(f"s_{c}") for c in columns]
    stats = df.agg(*aggs)
    rules = {}
    for c in columns:
        std = F.col(f"_z.s_{c}")
        rules[c] = (std > 0) & (F.abs((F.col(c) - F.col(f"_z.m_{c}")) / std) > limit)
    return (
        df.withColumn("_z", stats.select(F.struct(*stats.columns)).scalar())
        .withColumn(name, first_reason(rules))
        .drop("_z")
    )


def support_status(df: DataFrame, key: Column, y: Column, label: Column, below: float, floor: float = 120.0) -> DataFrame:
    """accepted / skipped (outside the range) / rejected with a reason."""
    in_range = F.coalesce((y >= floor) & (y < below), F.lit(False))
    reason = F.when(F.coalesce(F.trim(key), F.lit("")) == "", "missing_entity_id").when(
        in_range & ~F.coalesce(label.isin("Male", "Female"), F.lit(False)), "unsupported_label"
    )
    status = F.when(reason.isNotNull(), "rejected").when(~in_range, "skipped").otherwise("accepted")
    return df.withColumns({"status": status, "reason": reason})


@dataclass(frozen=True)
class IntakeColumns:
    code: str = "participant_code"
    age: str = "age_years"
    first: str = "height_measurement_1_cm"
    second: str = "height_measurement_2_cm"
    role: str = "collection_role"
    consent_research: str = "consent_audio_research"
    consent_training: str = "consent_model_training"


def intake_status(
    df: DataFrame, below: float, cols: IntakeColumns = IntakeColumns(),
    low: float = 120.0, high: float = 210.0, max_gap: float = 1.0, adult: float = 18.0,
) -> DataFrame:
    """Eligibility of consented, twice-measured rows; an unknown age is not adult."""
    code = F.trim(F.coalesce(F.col(cols.code), F.lit("")))
    age, a, b = (safe_number(F.col(c)) for c in (cols.age, cols.first, cols.second))
    role = F.lower(F.trim(F.coalesce(F.nullif(F.col(cols.role), F.lit("")), F.lit("development"))))
    both = F.coalesce(a.between(low, high) & b.between(low, high), F.lit(False))
    reason = first_reason({
        "missing_participant_code": code == "",
        "adult_participants_only": F.coalesce(age < adult, F.lit(True)),
        "audio_research_consent_missing": ~is_yes(F.col(cols.consent_research)),
        "model_training_consent_missing": ~is_yes(F.col(cols.consent_training)),
        "invalid_repeated_height": ~both,
        "height_measurements_disagree_gt_1cm": F.abs(a - b) > max_gap,
        "collection_role_must_be_development_or_sealed_test": ~role.isin("development", "sealed_test"),
    })
    y = (a + b) / 2.0
    status = F.when(reason.isNotNull(), "rejected").when(y >= below, "skipped").otherwise("accepted")
    return df.withColumns({"y": y, "role": role, "status": status, "reason": reason})


def forbidden_columns(columns: Sequence[str], forbidden: Sequence[str] = FORBIDDEN_COLUMNS) -> list[str]:
    """Direct-identifier columns present in a schema."""
    return sorted({c.strip().lower() for c in columns} & set(forbidden))


def require_pseudonymous(df: DataFrame) -> DataFrame:
    found = forbidden_columns(df.columns)
    if found:
        raise ValueError(f"direct-identifier columns present: {', '.join(found)}")
    return df


@dataclass(frozen=True)
class ItemPolicy:
    """Item acceptance limits (fixed values as defaults)."""

    min_duration: float = 2.0
    max_duration: float = 30.0
    min_rate: int = 8_000
    max_rms: float = -3.0
    min_rms: float = -50.0
    min_peak: float = 0.01
    max_clipping: float = 0.01


def item_rules(
    channels: Column, rate: Column, duration: Column, rms: Column, peak: Column, clipping: Column,
    policy: ItemPolicy = ItemPolicy(),
) -> dict[str, Column]:
    """Reasons in fixed order; missing level statistics mean there were no samples."""
    return {
        "unsupported_channels": ~F.coalesce(channels.isin(1, 2), F.lit(False)),
        "sample_rate_too_low": F.coalesce(rate < policy.min_rate, F.lit(True)),
        "too_short": F.coalesce(duration < policy.min_duration, F.lit(True)),
        "too_long": duration > policy.max_duration,
        "no_pcm_samples": rms.isNull(),
        "near_silent": rms < policy.min_rms,
        "excessive_level": rms > policy.max_rms,
        "low_peak": peak < policy.min_peak,
        "clipped": clipping > policy.max_clipping,
    }


def min_items(
    df: DataFrame, entity: str, least: int, reason: str, item_reason: str = "reason"
) -> DataFrame:
    """Accepted items of entities with fewer than ``least`` of them get the entity reason.

    A huge entity is counted and joined back instead of windowed.
    """
    ok = F.col(item_reason).isNull()
    joined = attach(df, [entity], {"n_ok": F.count_if(ok)})
    return joined.withColumn(
        item_reason, F.when(ok & (F.col("n_ok") < least), F.lit(reason)).otherwise(F.col(item_reason))
    )
