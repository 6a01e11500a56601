"""Risk levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threatloom.functions import constants as K


def risk_bucket(score: Column, medium: float, high: float) -> Column:
    """``high`` and ``medium`` thresholds are inclusive."""
    return (
        F.when(score >= F.lit(float(high)), F.lit("high"))
        .when(score >= F.lit(float(medium)), F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def worst_risk(*levels: Column) -> Column:
    """The most severe of several risk levels."""
    among = F.array(*levels)
    return (
        F.when(F.array_contains(among, "high"), "high")
        .when(F.array_contains(among, "medium"), "medium")
        .otherwise("low")
    )


def _lookup(level: Column, table: dict[str, str], other: str) -> Column:
    first, *rest = table.items()
    out = F.when(level == first[0], F.lit(first[1]))
    for name, value in rest:
        out = out.when(level == name, F.lit(value))
    return out.otherwise(F.lit(other))


def risk_color(level: Column) -> Column:
    """Display color of a level."""
    return _lookup(level, K.RISK_COLORS, K.OTHER_COLOR)


def risk_symbol(level: Column) -> Column:
    """Display symbol of a level."""
    return _lookup(F.lower(level), K.RISK_SYMBOLS, K.OTHER_SYMBOL)
