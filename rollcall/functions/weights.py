"""Training weights by rule."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.functions.numbers import bounded, target_bin


def edge_weight(y: Column) -> Column:
    """Heavier edges: low values 1.8, high values 1.35."""
    return F.when(y < 160.0, 1.80).when(y >= 175.0, 1.35).otherwise(F.lit(1.0))


def emphasis_weight(y: Column, group: Column, scheme: str) -> Column:
    """Named multiplier schemes over target range and group."""
    one = F.lit(1.0)
    very_low = F.when(y < 152.0, 4.0).otherwise(one)
    if scheme == "short_group":
        low = F.when((y < 160.0) & (group == 1), 6.0).when((y < 160.0) & (group == 0), 3.0)
        return low.otherwise(one) * very_low
    if scheme == "medium":
        return F.when((y >= 160.0) & (y < 175.0), 2.5).otherwise(one)
    if scheme == "short":
        return F.when(y < 160.0, 2.5).otherwise(one) * very_low
    if scheme == "none":
        return one
    raise ValueError(f"unknown weight scheme: {scheme}")


def table_weight(key: Column, table: Mapping[str, float], default: float = 1.0) -> Column:
    """Weight of a key from a small parameter table."""
    out = F.when(F.lit(False), F.lit(default))
    for name, weight in table.items():
        out = out.when(key == name, F.lit(float(weight)))
    return out.otherwise(F.lit(default))


def configured_weight(
    y: Column,
    group_name: Column,
    source: Column,
    bins: Mapping[str, float],
    group_bins: Mapping[str, float],
    source_bins: Mapping[str, float],
    extreme_low: tuple[float, float] = (152.0, 1.0),
    extreme_high: tuple[float, float] = (190.0, 1.0),
    cap: float = 25.0,
) -> Column:
    """Product of the bin, group x bin, source x bin and extreme factors, limited."""
    label = target_bin(y)
    weight = (
        table_weight(label, bins)
        * table_weight(F.concat_ws("_", group_name, label), group_bins)
        * table_weight(F.concat_ws("_", F.lower(source), label), source_bins)
        * F.when(y <= extreme_low[0], extreme_low[1]).otherwise(F.lit(1.0))
        * F.when(y >= extreme_high[0], extreme_high[1]).otherwise(F.lit(1.0))
    )
    return bounded(weight, 1e-3, cap)
