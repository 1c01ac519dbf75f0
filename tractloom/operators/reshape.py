"""Long to wide and back."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractloom.fixed_values import SURVEY_VARIABLES
from tractloom.operators.projection import drop_by_suffix, rename_by_pattern


def survey_slice(
    survey: DataFrame,
    state: str | None = None,
    county: str | None = None,
    labels: Mapping[str, object] | None = None,
) -> DataFrame:
    """Rows of a state or county; ``labels`` are equalities such as ``{"year": 2018}``."""
    prefix = (state or "") + (county or "")
    if county and not state:
        raise ValueError("a county code only has a meaning within a state")
    if prefix:
        survey = survey.filter(F.col("geoid").startswith(prefix))
    for name, value in (labels or {}).items():
        survey = survey.filter(F.col(name) == value)
    return survey


def pivot_survey(
    survey: DataFrame,
    variables: Mapping[str, str] = SURVEY_VARIABLES,
    margins: bool = True,
) -> DataFrame:
    """One row per area with columns ``<name>E`` (estimate) and ``<name>M`` (margin).

    The variables are known beforehand, so each becomes one conditional
    aggregate: a single shuffle of partial results, and columns nobody reads
    are pruned.
    """
    measures = {"E": "estimate", "M": "moe"} if margins else {"E": "estimate"}
    columns = [
        F.max(F.when(F.col("variable") == code, F.col(measure))).alias(f"{name}{mark}")
        for name, code in variables.items()
        for mark, measure in measures.items()
    ]
    cells = survey.filter(F.col("variable").isin(list(variables.values())))
    return cells.groupBy("geoid").agg(*columns)


def plain_estimates(wide: DataFrame) -> DataFrame:
    """Drop names and margins and take the ``E`` off the estimate columns."""
    if "GEOID" in wide.columns:
        wide = wide.withColumnRenamed("GEOID", "geoid")
    return rename_by_pattern(drop_by_suffix(wide, "M", also=["NAME"]), "E$")


def unpivot_keeping_nulls(frame: DataFrame, keys: Iterable[str] = ("geoid",)) -> DataFrame:
    """One row per cell with columns ``name`` and ``value``."""
    keys = list(keys)
    values = [c for c in frame.columns if c not in keys]
    return frame.unpivot(keys, values, "name", "value")
