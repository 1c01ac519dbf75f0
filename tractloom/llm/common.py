"""What several corpus operators share: quoting, tokens, settled tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white space characters that separate words.
SPACES = " \t\n\x0b\f\r"

_own_folders: dict[str, str] = {}


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(docs: DataFrame) -> Column:
    """All columns as one struct, so that added columns can't clash with them."""
    return F.struct(*[col(c) for c in docs.columns])


def unpacked(df: DataFrame, struct: str, names: list[str], added: list[str] = ()) -> DataFrame:
    """The columns of a struct made by `whole`, then the added ones, which replace any of the same name."""
    lower = {a.lower() for a in added}
    kept = [n for n in names if n.lower() not in lower]
    return df.select(*[F.col(struct).getField(n).alias(n) for n in kept], *[F.col(a) for a in added])


def words(text: Column) -> Column:
    """Maximal runs of characters that are no white space; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; a null text is empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a folder of its own; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="tractloom-")
    return _own_folders[app]


def settle(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back; `by` names a column to keep apart in folders.

    Cuts the lineage, survives lost executors, and lets later steps read only the columns they need.
    The folder is left to whoever cleans spark.checkpoint.dir.
    """
    path = f"{shared_folder(df.sparkSession)}/tractloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*[by] if by else []).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
