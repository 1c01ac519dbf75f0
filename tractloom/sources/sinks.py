"""Writers. All paths are meant for a store every executor can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DONE = "_SUCCESS"
_VERSION = "version="


def _folder(spark: SparkSession, path: str):  # noqa: ANN202
    """The file system of a path, and the path, as Spark's own readers see them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def snapshot_versions(spark: SparkSession, path: str) -> dict[int, bool]:
    """Numbers of the versions in a snapshot folder, and whether each was written to its end."""
    files, where = _folder(spark, path)
    if not files.exists(where):
        return {}
    found = [f.getPath() for f in files.listStatus(where)]
    versions = [p for p in found if p.getName().startswith(_VERSION)]
    done = {p.getName(): files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, _DONE)) for p in versions}
    return {int(name.removeprefix(_VERSION)): whole for name, whole in sorted(done.items())}


def write_snapshot(frame: DataFrame, path: str, by: str = "geoid") -> int:
    """Write a table as a new version of a snapshot and return the version's number.

    Nothing is overwritten: readers see the version before until the new one is complete, and go on seeing it if the
    writing fails. Rows are sorted by ``by``, if there is such a column, in ranges: a lookup of one value then skips
    all files and row groups but those of its range.
    """
    number = max(snapshot_versions(frame.sparkSession, path), default=0) + 1
    if by in frame.columns:
        frame = frame.repartitionByRange(by).sortWithinPartitions(by)
    frame.write.mode("error").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(
        f"{path}/{_VERSION}{number}"
    )
    return number


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest complete version, or the one asked for; a folder without versions is read as it is."""
    versions = snapshot_versions(spark, path)
    if not versions:
        return spark.read.parquet(path)
    whole = [n for n, done in versions.items() if done]
    if not whole or (version is not None and version not in whole):
        raise FileNotFoundError(f"no complete version {'' if version is None else version} in {path}")
    return spark.read.parquet(f"{path}/{_VERSION}{max(whole) if version is None else version}")


def append_csv(frame: DataFrame, path: str) -> None:
    """Add rows to a CSV folder, creating it at first. Each part has its header line.

    Empty text is written as nothing at all and reads back as NULL.
    """
    writer = frame.write.mode("append").option("header", True)
    writer.option("emptyValue", "").option("escape", '"').csv(path)
