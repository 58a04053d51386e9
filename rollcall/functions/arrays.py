"""Arrays inside one row: frames, embeddings, crops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def array_mean(values: Column) -> Column:
    """Mean of the non-NULL entries; NULL when there are none."""
    present = F.filter(values, lambda x: x.isNotNull())
    return F.when(F.size(present) > 0, array_sum(present) / F.size(present))


def array_median(values: Column) -> Column:
    present = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(present)
    low = F.get(present, F.floor((n - 1) / 2).cast("int"))
    high = F.get(present, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def to_doubles(values: Column) -> Column:
    return values.cast("array<double>")


def frames_of(values: Column, width: int) -> Column:
    """Flat array to frames of ``width`` entries; the last one may be shorter, an empty array has none."""
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.ceil(F.size(values) / width).cast("int") - 1))
    frames = F.transform(starts, lambda i: F.slice(values, i * width + 1, width))
    return F.when(F.size(values) == 0, F.slice(F.array(values), 1, 0)).otherwise(frames)


def spacing_summary(
    values: Column,
    speed: float = 35000.0,
    low: float = 10.0,
    high: float = 22.0,
    ratio: float = 6.7,
    default: tuple[float, float, float] = (15.5, 1129.0, 103.85),
    floor: float = 50.0,
    min_spacing: float = 100.0,
) -> Column:
    """Struct (length, spacing, estimate) from an ascending frequency array.

    Entries at or under ``floor`` are dropped; with fewer than two left, or a
    mean spacing of at most ``min_spacing``, the default triple is returned.
    """
    kept = F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x) & (x > floor))
    n = F.size(kept)
    spacing = F.when(n >= 2, (F.element_at(kept, -1) - F.element_at(kept, 1)) / (n - 1))
    spacing = F.when(spacing > min_spacing, spacing)
    length = F.least(F.greatest(F.lit(speed) / (spacing * 2.0), F.lit(low)), F.lit(high))
    length = F.when(spacing.isNotNull(), length)
    return F.struct(
        F.coalesce(length, F.lit(default[0])).alias("length"),
        F.coalesce(spacing, F.lit(default[1])).alias("spacing"),
        F.coalesce(length * ratio, F.lit(default[2])).alias("estimate"),
    )


def spacing_bounds(speed: float, low: float, high: float) -> tuple[float, float]:
    return speed / (2.0 * high), speed / (2.0 * low)


def robust_inverse(x: Column, speed: float = 34000.0, low: float = 10.0, high: float = 35.0) -> Column:
    """``speed / (2 x)`` with x limited to the plausible range; 0 for unusable x."""
    lo, hi = spacing_bounds(speed, low, high)
    usable = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) & (x > 0)
    return F.when(usable, F.lit(speed) / (F.least(F.greatest(x, F.lit(lo)), F.lit(hi)) * 2.0)).otherwise(F.lit(0.0))


def share(values: Column, test: Callable[[Column], Column]) -> Column:
    """Share of entries that meet the test; 1 for an empty array."""
    return F.when(
        F.size(values) > 0,
        F.size(F.filter(values, lambda x: F.coalesce(test(x), F.lit(True)))) / F.size(values),
    ).otherwise(F.lit(1.0))


def repair_column(frames: Column, source: int, target: int, fn: Callable[[Column], Column]) -> Column:
    """Each frame with entry ``target`` rewritten from entry ``source`` (0-based)."""
    return F.transform(
        frames,
        lambda f: F.concat(
            F.slice(f, 1, target),
            F.array(fn(F.element_at(f, source + 1))),
            F.slice(f, target + 2, 1 << 30),
        ),
    )


def column_of(frames: Column, index: int) -> Column:
    return F.transform(frames, lambda f: F.element_at(f, index + 1))


def crop(frames: Column, length: int, mode: str, uniform: Column | None = None) -> Column:
    """Head, centre or seeded-random window of ``length`` frames."""
    spare = F.greatest(F.size(frames) - length, F.lit(0))
    if mode == "random":
        start = F.floor(uniform * (spare + 1)).cast("int")
    elif mode == "center":
        start = F.floor(spare / 2).cast("int")
    elif mode == "head":
        start = F.lit(0)
    else:
        raise ValueError(f"unknown crop mode: {mode}")
    return F.slice(frames, start + 1, length)


def crop_starts(size: Column, length: int, count: int) -> Column:
    """Distinct, evenly spaced start positions of ``count`` crops."""
    spare = F.greatest(size - length, F.lit(0))
    if count <= 1:
        return F.array(F.lit(0))
    if count == 2:
        return F.array_distinct(F.array(F.lit(0), spare))
    steps = F.array(*[F.bround(spare * F.lit(i) / F.lit(count - 1)).cast("int") for i in range(count)])
    return F.when(spare > 0, F.array_distinct(steps)).otherwise(F.array(F.lit(0)))


def masked_mean(frames: Column, mask: Column, width: int) -> Column:
    """Mean frame over the frames whose mask is true; zeros when none is."""
    kept = F.filter(F.arrays_zip(frames.alias("f"), mask.alias("m")), lambda z: z["m"])
    zero = F.array_repeat(F.lit(0.0), width)
    total = F.aggregate(kept, zero, lambda a, z: F.zip_with(a, z["f"], lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))


def append_to_frames(frames: Column, vector: Column) -> Column:
    """Every frame followed by the item's vector; unchanged without one."""
    return F.when(vector.isNotNull(), F.transform(frames, lambda f: F.concat(f, vector))).otherwise(frames)


def vector_mean(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2.0)


def vector_delta(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def vector_norm(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x))
