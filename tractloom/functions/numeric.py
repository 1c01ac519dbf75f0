"""Numeric column expressions: ratios, scale positions, display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tractloom.fixed_values import MISSING_TEXT


def _as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ratio(part: Column | str, whole: Column | str) -> Column:
    """``part / whole`` as double; NULL when ``whole`` is 0 or either is NULL."""
    return F.try_divide(_as_column(part).cast("double"), _as_column(whole).cast("double"))


def scale_position(value: Column, low: Column, high: Column, reverse: bool = False) -> Column:
    """Place ``value`` on 0..1 between ``low`` and ``high``.

    A domain of a single value has no width; everything sits in the middle.
    """
    position = (
        F.when(value.isNull(), F.lit(None).cast("double"))
        .when(low == high, F.lit(0.5))
        .otherwise(F.try_divide(value - low, high - low))
    )
    return F.lit(1.0) - position if reverse else position


def display_text(value: Column, style: Column) -> Column:
    """Text of ``value`` in the style ``num``, ``rt``, ``pct`` or ``cur``.

    NULL, NaN and infinite values become the missing-value dash.
    """
    finite = F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)
    dollars = F.concat(
        F.when(finite < 0, F.lit("-$")).otherwise(F.lit("$")),
        F.format_number(F.abs(finite), 0),
    )
    text = (
        F.when(style == "cur", dollars)
        .when(style == "pct", F.concat(F.format_number(finite * 100, 1), F.lit("%")))
        .when(style == "num", F.format_number(finite, 0))
        .when(style == "rt", F.format_number(finite, 1))
        .otherwise(finite.cast("string"))
    )
    return F.coalesce(text, F.lit(MISSING_TEXT))
