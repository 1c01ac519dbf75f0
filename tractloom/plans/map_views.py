"""Read-side views of the area table: menu, colour scale, legend and detail table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tractloom.fixed_values import TOTALS_GROUP
from tractloom.functions.numeric import display_text, scale_position
from tractloom.functions.text import menu_label
from tractloom.operators.projection import quoted
from tractloom.operators.reshape import unpivot_keeping_nulls

def variable_menu(meta: DataFrame, exclude_prefix: str | None = None) -> DataFrame:
    """Menu entries: place in the menu, label and column name. The lowest ``order`` is the default.

    Only groups named exactly ``Totals`` are left out, which spares groups
    with a year remark; ``exclude_prefix`` leaves those out as well.
    """
    shown = meta.filter(F.col("var_group") != TOTALS_GROUP)
    if exclude_prefix is not None:
        shown = shown.filter(~F.col("var_group").startswith(exclude_prefix))
    label = menu_label(F.col("var_group"), F.col("display_name")).alias("label")
    return shown.select("order", label, "var_name")


def _present(table: DataFrame, *columns: str) -> list[str]:
    return [c for c in columns if c in table.columns]


def choropleth(table: DataFrame, variable: str, reverse: bool = False) -> DataFrame:
    """Every area's value and its position 0..1 on the colour scale, with its shape if there is one.

    Only the columns shown are computed, and the table is computed once: the domain comes from the cells themselves.
    """
    layer = choropleth_layers(table.select(*_present(table, "geoid", "geometry"), quoted(variable)), reverse)
    return layer.drop("name")


def choropleth_layers(table: DataFrame, reverse: bool = False) -> DataFrame:
    """The layers of all indicators at once: a row per area and indicator, with the position on its own scale.

    The table is read once. Its cells meet the low and high of their indicator where they are sorted by indicator; an
    indicator has one cell per area, so no task gets more rows than there are areas.
    """
    kept = _present(table, "geoid", "geometry")
    cells = unpivot_keeping_nulls(table, keys=kept)
    value, layer = F.col("value"), W.partitionBy("name")
    low, high = F.min(value).over(layer), F.max(value).over(layer)
    return cells.select(
        "name",
        "geoid",
        "value",
        scale_position(value, low, high, reverse).alias("pos"),
        value.isNull().alias("is_missing"),
        *[c for c in kept if c != "geoid"],
    )


def choropleth_legend(table: DataFrame, variable: str) -> DataFrame:
    """Distinct values, highest first."""
    values = table.select(F.col(quoted(variable)).alias("value")).filter(F.col("value").isNotNull())
    return values.distinct().orderBy(F.desc("value"))


def legend_breaks(table: DataFrame, variable: str, about: int = 5) -> DataFrame:
    """Round values for a legend, highest first: steps of 1, 2 or 5 times a power of ten within the domain.

    A domain of a single value has that value's whole steps only; one without values has no breaks.
    """
    value = F.col(quoted(variable)).cast("double")
    domain = table.agg(F.min(value).alias("low"), F.max(value).alias("high")).filter("low IS NOT NULL")
    rough = (F.col("high") - F.col("low")) / about
    base = F.pow(F.lit(10.0), F.floor(F.log10(rough)))
    factor = F.when(rough <= base, 1).when(rough <= 2 * base, 2).when(rough <= 5 * base, 5).otherwise(10)
    stepped = domain.withColumn("step", F.when(F.col("low") == F.col("high"), F.lit(1.0)).otherwise(base * factor))
    first = F.ceil(F.col("low") / F.col("step")).cast("long")
    last = F.floor(F.col("high") / F.col("step")).cast("long")
    places = F.when(first <= last, F.sequence(first, last))
    found = stepped.select("step", F.explode(places).alias("place"))
    return found.select((F.col("place").cast("double") * F.col("step")).alias("value")).orderBy(F.desc("value"))


def detail_table(table: DataFrame, meta: DataFrame, geoid: str) -> DataFrame:
    """The described indicators of one area, formatted and in display order.

    Every metadata row appears, with a dash where the area has no such value.
    """
    area = table.filter(F.col("geoid") == geoid).drop("geoid", "geometry")
    cells = unpivot_keeping_nulls(area, keys=[])
    rows = cells.join(meta, cells["name"] == meta["var_name"], "right").orderBy("order")
    text = display_text(F.col("value"), F.col("val_fmt"))
    return rows.select("order", "var_group", "display_name", text.alias("value_text"))


def detail_tables(table: DataFrame, meta: DataFrame) -> DataFrame:
    """The described indicators of every area, formatted; :func:`detail_table` for all at once.

    A row per area and described column: cells meet their metadata by name. Metadata that names no column of the
    table belongs to no cell; :func:`undescribed_columns` has it.
    """
    cells = unpivot_keeping_nulls(table.drop("geometry"))
    rows = cells.join(meta, cells["name"] == meta["var_name"])
    text = display_text(F.col("value"), F.col("val_fmt"))
    return rows.select("geoid", "order", "var_group", "display_name", text.alias("value_text"))


def undescribed_columns(table: DataFrame, meta: DataFrame) -> DataFrame:
    """Metadata whose name is no column of the table: it is a dash for every area, so it is given once."""
    named = [c for c in table.columns if c not in ("geoid", "geometry")]
    return meta.filter(~F.col("var_name").isin(named)).select("order", "var_group", "var_name", "display_name")
