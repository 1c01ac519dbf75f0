"""Joins, unions and first-row selection between tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def full_join_on(frames: Sequence[DataFrame], key: str = "geoid") -> DataFrame:
    """Chain of full outer joins with one coalesced key column in front."""
    return reduce(lambda left, right: left.join(right, key, "full_outer"), frames)


def merge_keyed(frames: Sequence[DataFrame], key: str = "geoid") -> DataFrame:
    """The full outer join of tables that hold one row per non-NULL key.

    Their columns are stacked and folded in one aggregation, in place of one
    shuffle per table.
    """
    stacked = union_filling(frames)
    values = [c for c in stacked.columns if c != key]
    return stacked.groupBy(key).agg(*[F.max(c).alias(c) for c in values])


def union_filling(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables by column name; absent columns are NULL."""
    return reduce(lambda top, more: top.unionByName(more, allowMissingColumns=True), frames)


def anti_chain(frame: DataFrame, others: Sequence[DataFrame], key: str = "uid") -> DataFrame:
    """Rows of ``frame`` whose key is in none of the others.

    All steps share the key, so ``frame`` is shuffled once at most. Keys of the others are made distinct on the map
    side first, so one that they repeat very often costs no more than any other.
    """
    return reduce(lambda kept, other: kept.join(other.select(key).distinct(), key, "left_anti"), others, frame)


#: A key is popular if it has at least this share of the rows; the sketch keeps so many candidates a task.
POPULAR_SHARE = 0.01
TRACKED = 2000


def popular_keys(rows: DataFrame, key: str, share: float = POPULAR_SHARE) -> Column:
    """The keys that hold at least a share of the rows, as an array of at most ``1 / share`` values.

    Every task keeps a frequency sketch of fixed size; only sketches move. Counts are upper bounds, off by a share
    of rows far below the wanted one.
    """
    most = int(1 / share)
    top = F.expr(f"approx_top_k(`{key}`, {most}, {TRACKED})")
    counted = rows.filter(F.col(f"`{key}`").isNotNull()).agg(top.alias("top"), F.count("*").alias("n"))
    wanted = F.filter("top", lambda t: t["count"] >= F.col("n") * share)
    return counted.select(F.transform(wanted, lambda t: t["item"])).scalar()


def spread_left_join(
    rows: DataFrame, table: DataFrame, key: str, by: str, spread: int = 4, share: float = POPULAR_SHARE
) -> DataFrame:
    """Left join to a table with one row per key, when very many rows may share a key.

    Rows of a popular key are split into ``spread`` parts by another column, and the table's row is repeated for each
    part; all other keys have one part and one row. A popular key so becomes several tasks, and because both sides
    are then exchanged for this join, adaptive execution can split what is still too large.
    """
    popular = popular_keys(rows, key, share)
    at = F.col(f"`{key}`")
    split = F.pmod(F.xxhash64(by), F.lit(spread)).cast("int")
    parts = rows.withColumn("part", F.when(F.array_contains(popular, at), split).otherwise(0))
    every = F.when(F.array_contains(popular, at), F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))
    copies = table.withColumn("part", F.explode(every))
    return parts.join(copies, [key, "part"], "left").drop("part")


def first_per_key(frame: DataFrame, key: str, order: Column | str) -> DataFrame:
    """The row with the lowest ``order`` of each key; ``order`` must be unique within a key.

    An aggregation with map-side combine: no key's rows are gathered or sorted.
    """
    others = [c for c in frame.columns if c != key]
    return frame.groupBy(key).agg(*[F.min_by(c, order).alias(c) for c in others])


def fanout_counts(left: DataFrame, right: DataFrame, key: str, left_by: str, right_by: str) -> DataFrame:
    """Row counts of ``left LEFT JOIN right USING (key)`` by a column of each side.

    Both sides are counted per key first and the counts multiplied, so the
    joined rows are never produced.
    """
    lefts = left.groupBy(key, left_by).agg(F.count("*").alias("lefts"))
    rights = right.groupBy(key, right_by).agg(F.count("*").alias("rights"))
    joined = lefts.join(rights, key, "left")
    rows = F.col("lefts") * F.coalesce("rights", F.lit(1))
    return joined.groupBy(left_by, right_by).agg(F.sum(rows).alias("n_rows"))
