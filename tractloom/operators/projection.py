"""Projections driven by column names and types, resolved when the plan is built."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractloom.fixed_values import EMPTY_TEXT, RATE_BASE


def quoted(name: str) -> str:
    """A column name as SQL takes it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def rename_by_pattern(frame: DataFrame, pattern: str, replacement: str = "") -> DataFrame:
    """Replace the first match of ``pattern`` in every column name."""
    renamed = {c: re.sub(pattern, replacement, c, count=1) for c in frame.columns}
    return frame.withColumnsRenamed({old: new for old, new in renamed.items() if old != new})


def drop_by_suffix(frame: DataFrame, suffix: str, also: Iterable[str] = ()) -> DataFrame:
    """Drop columns ending with ``suffix`` in either case, and those named in ``also``."""
    named = set(also)
    doomed = [c for c in frame.columns if c in named or c.lower().endswith(suffix.lower())]
    return frame.drop(*doomed)


def across(frame: DataFrame, columns: Iterable[str], expression: str, names: str = "{col}") -> DataFrame:
    """Apply one SQL expression to several columns, naming results by a template.

    ``{col}`` stands for the column in both templates, in the expression with quotes.
    """
    return frame.withColumns(
        {names.format(col=c): F.expr(expression.format(col=quoted(c))) for c in columns}
    )


def cast_except(frame: DataFrame, keys: Iterable[str], dtype: str = "double") -> DataFrame:
    kept = set(keys)
    columns = [(c, F.col(quoted(c))) for c in frame.columns]
    return frame.select(*[column if c in kept else column.cast(dtype).alias(c) for c, column in columns])


def fill_text(frame: DataFrame, text: str = EMPTY_TEXT) -> DataFrame:
    """Fill NULLs in string columns only."""
    return frame.na.fill(text)


def add_rates(
    frame: DataFrame,
    base: str,
    suffix: str = "_num",
    keys: Iterable[str] = ("geoid", "geometry"),
    per: int = RATE_BASE,
) -> DataFrame:
    """Add a rate per 100 ``base`` for each column ending with ``suffix``.

    All columns but the keys become double; the rate of ``x_num`` is ``x_rt``.
    Dividing by zero gives NULL.
    """
    counted = [c for c in frame.columns if c.lower().endswith(suffix)]
    rate = f"try_divide(CAST({{col}} AS DOUBLE), CAST({quoted(base)} AS DOUBLE)) * {per}"
    rated = across(frame, counted, rate, "{col}_rt")
    return rename_by_pattern(cast_except(rated, keys), f"{suffix}_rt", "_rt")
