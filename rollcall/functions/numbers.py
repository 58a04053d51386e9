"""Numbers: parsing, units, bins, guards.  Missing is always NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(c)


def ratio(a: Column, b: Column) -> Column:
    """a / b of doubles as IEEE has it: by zero it is NaN or infinite, not an error."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(a / b)


def safe_number(text: Column, strip_commas: bool = False) -> Column:
    """Text to a finite double, or NULL."""
    cleaned = F.trim(text)
    if strip_commas:
        cleaned = F.replace(cleaned, F.lit(","), F.lit(""))
    return finite(cleaned.try_cast("double"))


def bounded(c: Column, low: float | Column, high: float | Column) -> Column:
    """Limit to [low, high] a value that is known to be present.

    ``least``/``greatest`` skip NULL, so a NULL would come out as ``low``; use
    ``clip`` where the value may be missing.  The argument is used once, which
    keeps nested scores small.
    """
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.least(F.greatest(c, lit(low)), lit(high))


def bounded01(c: Column) -> Column:
    return bounded(c, 0.0, 1.0)


def clip(c: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; NULL stays NULL."""
    return F.when(c.isNotNull(), bounded(c, low, high))


def imperial_to_cm(text: Column) -> Column:
    """``5'11"`` or plain feet to centimetres; malformed text gives NULL."""
    bare = F.replace(F.trim(text), F.lit('"'), F.lit(""))
    pattern = r"^(\d+)(?:'(\d*))?$"
    feet = F.regexp_extract(bare, pattern, 1).try_cast("int")
    inches = F.coalesce(F.regexp_extract(bare, pattern, 2).try_cast("int"), F.lit(0))
    return F.bround((feet * 12 + inches) * F.lit(2.54), 2)


def cm_to_feet_inches(cm: Column) -> Column:
    total = cm / F.lit(2.54)
    return F.format_string("%d'%.1f\"", F.floor(total / 12), F.pmod(total, F.lit(12.0)))


def us_date(text: Column) -> Column:
    """``MM/DD/YY`` with every year after 2000 moved back a century."""
    day = F.to_date(F.try_to_timestamp(F.trim(text), F.lit("MM/dd/yy")))
    return F.when(F.year(day) > 2000, F.add_months(day, -1200)).otherwise(day)


def derive_age(recorded: Column, born: Column) -> Column:
    """Whole 365-day years between two ``MM/DD/YY`` texts."""
    return F.floor(F.datediff(us_date(recorded), us_date(born)) / 365).cast("int")


def label_bins(
    c: Column,
    edges: Sequence[float],
    labels: Sequence[str],
    missing: str = "unknown",
    closed_right: Sequence[float] = (),
) -> Column:
    """Label by edges: half-open ``[lo, hi)``; edges in ``closed_right`` belong below."""
    if len(labels) != len(edges) + 1:
        raise ValueError("one more label than edges is needed")
    out = F.when(c.isNull() | F.isnan(c), F.lit(missing))
    for edge, label in zip(edges, labels):
        out = out.when(c <= edge if edge in closed_right else c < edge, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


# Bin edges of the three standard bins.
TARGET_EDGES, TARGET_LABELS = (160.0, 175.0), ("short", "medium", "tall")
DURATION_EDGES, DURATION_LABELS = (2.5, 5.0), ("short", "medium", "long")
QUALITY_EDGES, QUALITY_LABELS = (0.5, 0.75), ("low", "medium", "high")


def target_bin(c: Column) -> Column:
    return label_bins(c, TARGET_EDGES, TARGET_LABELS)


def duration_bin(c: Column) -> Column:
    return label_bins(c, DURATION_EDGES, DURATION_LABELS)


def quality_bin(c: Column) -> Column:
    return label_bins(c, QUALITY_EDGES, QUALITY_LABELS)


def subgroup_label(value: Column, group: Column) -> Column:
    """Display label; here 175 itself still counts as medium."""
    size = label_bins(value, (160.0, 175.0), ("Short", "Medium", "Tall"), closed_right=(175.0,))
    span = label_bins(value, (160.0, 175.0), ("(< 160 cm)", "(160 - 175 cm)", "(> 175 cm)"), closed_right=(175.0,))
    return F.concat_ws(" ", size, group, span)


def normalize(c: Column, mean: Column, std: Column) -> Column:
    """Standardise; missing statistics mean 0 and 1, a tiny std means no scaling."""
    centred = c - F.coalesce(mean, F.lit(0.0))
    spread = F.coalesce(std, F.lit(1.0))
    return F.when(spread < 1e-12, centred).otherwise(centred / spread)


def denormalize(c: Column, mean: Column, std: Column) -> Column:
    return c * F.coalesce(std, F.lit(1.0)) + F.coalesce(mean, F.lit(0.0))
