"""Typed readers."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import pairwise

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractloom.fixed_values import INDICATORS
from tractloom.operators.projection import quoted
from tractloom.operators.reshape import survey_slice
from tractloom.plans.area_table import AreaSources
from tractloom.sources import schemas


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header line; quotes inside quoted text are doubled."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


_KINDS = ((T.IntegralType,), (T.DateType, T.TimestampType, T.TimestampNTZType), (T.FractionalType,))


def typed(frame: DataFrame, schema: str, name: str, unused: tuple[str, ...] = ()) -> DataFrame:
    """The used columns of a schema, after a check that the table has them as declared.

    Whole numbers of any width pass for each other, as do dates and timestamps: filters on them still reach the
    scan. Anything else is refused here, by name, and not in the middle of a job.
    """
    have = {f.name: f.dataType for f in frame.schema.fields}
    wanted = [f for f in T.StructType.fromDDL(schema).fields if f.name not in unused]
    for field in wanted:
        kind = have.get(field.name)
        alike = any(isinstance(field.dataType, k) and isinstance(kind, k) for k in _KINDS)
        if kind != field.dataType and not alike:
            found = "missing" if kind is None else kind.simpleString()
            raise TypeError(f"{name}.{field.name} should be {field.dataType.simpleString()}, but is {found}")
    return frame.select(*[f.name for f in wanted])


def read_area_list(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.AREA_LIST)


def read_indicator_meta(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.INDICATOR_META)


def standard_indicator_meta(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INDICATORS, schemas.INDICATOR_META)


def read_members(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MEMBERS).json(path)


def read_survey(
    spark: SparkSession,
    path: str,
    state: str | None = None,
    county: str | None = None,
    labels: Mapping[str, object] | None = None,
) -> DataFrame:
    """Survey cells of a state or county; ``labels`` on partition columns prune folders."""
    cells = survey_slice(spark.read.parquet(path), state, county, labels)
    return typed(cells, schemas.SURVEY, path)


def read_shapes(spark: SparkSession, path: str, srid: int = 0) -> DataFrame:
    """Shapes of areas from parquet files with ``geoid`` and ``wkb``, as Spark's GEOMETRY type.

    They go into ``AreaSources(shapes=...)`` and reach map layers as the column ``geometry``. The type needs a session
    with ``spark.sql.geospatial.enabled``; Spark says so where it is off.
    """
    stored = typed(spark.read.parquet(path), schemas.SHAPES, path)
    return stored.select("geoid", F.st_setsrid(F.st_geomfromwkb("wkb"), srid).alias("geometry"))


def read_address_reference(spark: SparkSession, path: str) -> DataFrame:
    """Known addresses with coordinates, for :func:`tractloom.resolve_cascade`."""
    return read_csv(spark, path, schemas.ADDRESS_REFERENCE)


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Hand-made coordinates with their position in the file; none if there is no file.

    ``line`` orders rows by the age and name of their file and their place in
    it, so that "first" means the same as for someone reading the files. Files
    are ranked once, from their listing; a line is then one whole number: the
    rank of its file, where its split begins, and its place among the rows.
    """
    try:
        lines = read_csv(spark, path, schemas.OVERRIDES)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame(
            [], "line DECIMAL(38, 0), uid STRING, latitude DOUBLE, longitude DOUBLE"
        )
    placed = lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").cast("decimal(15,0)").alias("start"),
        F.monotonically_increasing_id().cast("decimal(19,0)").alias("row"),
        "uid",
        "latitude",
        "longitude",
    )
    # A row per file, without reading one.
    ranked = placed.join(F.broadcast(file_ranks(spark, path)), "file")
    tens = lambda n: F.lit("1" + "0" * n).cast(f"decimal({n + 1},0)")
    # 5 digits, as many files as a listing may have; 14 for the start, 100 TB; 19 for the place.
    line = F.col("rank").cast("decimal(5,0)") * tens(33) + F.col("start") * tens(19) + F.col("row")
    return ranked.select(line.cast("decimal(38,0)").alias("line"), "uid", "latitude", "longitude")


def file_ranks(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder and their rank by age, then name."""
    listed = spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("age")
    )
    return listed.select("file", F.row_number().over(W.orderBy("age", "file")).alias("rank"))


#: Row numbers that no count reads.
_UNUSED = ("problemid", "violationid")

_RELATIONS = {
    "parcels": ("pluto_19v2", schemas.PARCELS),
    "complaints": ("hpd_complaints", schemas.COMPLAINTS),
    "complaint_problems": ("hpd_complaint_problems", schemas.COMPLAINT_PROBLEMS),
    "violations": ("hpd_violations", schemas.VIOLATIONS),
    "evictions": ("marshal_evictions_19", schemas.EVICTIONS),
    "rentstab_summary": ("rentstab_summary", schemas.RENTSTAB_SUMMARY),
    "rentstab_v2": ("rentstab_v2", schemas.RENTSTAB_V2),
}


def read_area_sources(
    spark: SparkSession, folder: str, survey: DataFrame, shapes: DataFrame | None = None
) -> AreaSources:
    """The seven record tables from parquet copies named like the database tables."""
    tables = {
        role: typed(spark.read.parquet(f"{folder}/{table}"), schema, table, _UNUSED)
        for role, (table, schema) in _RELATIONS.items()
    }
    return AreaSources(survey=survey, shapes=shapes, **tables)


def jdbc_options(table: str, split: tuple[str, object, object, int] | None = None) -> dict[str, str]:
    """Reader options for one table, read in parallel ranges of a column if given."""
    options = {"dbtable": table}
    if split is not None:
        column, lower, upper, partitions = split
        options |= {
            "partitionColumn": column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    return options


def equal_splits(keys: DataFrame, column: str, parts: int) -> list[str]:
    """Conditions that divide a table into parts of about equal numbers of rows, however its key is spread.

    The bounds are quantiles of the key in ``keys``, a copy or a sample of the table, from a sketch that the tasks
    build and merge. Every row meets exactly one condition, NULL keys the first. A key whose rows exceed a part's share
    has a part of its own with the keys up to the next bound; a single value can't be divided.
    """
    ranks = [i / parts for i in range(1, parts)]
    at = F.col(quoted(column))
    found = keys.agg(F.percentile_approx(at, F.lit(ranks), F.lit(100 * parts)).alias("bounds")).first()["bounds"] or []
    bounds = sorted(set(found))
    if not bounds:
        return ["1 = 1"]
    middle = [f"{column} >= {a} AND {column} < {b}" for a, b in pairwise(bounds)]
    return [f"{column} < {bounds[0]} OR {column} IS NULL", *middle, f"{column} >= {bounds[-1]}"]


def read_database_sources(
    spark: SparkSession,
    url: str,
    survey: DataFrame,
    split_on: Mapping[str, tuple[str, object, object, int] | list[str]],
    shapes: DataFrame | None = None,
    **connection: str,
) -> AreaSources:
    """The seven record tables over JDBC.

    ``split_on`` maps every database table to (column, lower, upper,
    partitions) or to the conditions of :func:`equal_splits`, each of which
    becomes a task: no table is left to a single task.
    """
    missing = {table for table, _ in _RELATIONS.values()} - set(split_on)
    if missing:
        raise ValueError(f"no split given for {sorted(missing)}")
    tables = {}
    for role, (table, schema) in _RELATIONS.items():
        split = split_on[table]
        if isinstance(split, list):
            loaded = spark.read.jdbc(url, table, predicates=split, properties=connection)
        else:
            reader = spark.read.format("jdbc").option("url", url).options(**connection)
            loaded = reader.options(**jdbc_options(table, split)).load()
        tables[role] = typed(loaded, schema, table, _UNUSED)
    return AreaSources(survey=survey, shapes=shapes, **tables)
