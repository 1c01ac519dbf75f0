"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash. A document's virtual finish time is the source's words up to and with
it, divided by the source's target; a second pass over a source continues where the first ended. Everything sorted by
finish time is the mix, cut off where the total budget is spent.

No source passes through one task: running sums are taken within hash ranges of a source, on top of sums per range,
and the place of the cut is found from sums per slice of virtual time before rows are looked at.

Nulls and odd input: null texts have size 0 and are never taken; a null source is one source, the last in order;
null ids are fine; repeated rows count as often as they occur; empty tables give empty mixes. Of a text of any length
only its number of words is moved about. Equal finish times go by source, then by the words before them. Result columns
replace input columns of the same name; all others pass through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tractloom.llm.common import settle, unpacked, whole, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_PASSES = 2
#: Rows of one hash range of the largest possible source, and of one slice of virtual time.
RANGE_ROWS = 8_000
SLICE_ROWS = 2_000
KEY_DIGITS = 15

ADDED = ["size", "source_size", "target", "taken", "finish"]


def sizes(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def shuffle_key(doc_id: Column, source: Column, size: Column) -> Column:
    """60 bits of an MD5; rows without an id are told apart by their size."""
    digest = F.md5(F.concat_ws(":", doc_id.cast("string"), source, size.cast("string")))
    return F.conv(F.substring(digest, 1, KEY_DIGITS), 16, 10).cast("long")


def targets(sizes_by_source: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(source, source_size) to (source, source_size, rank, target). One row per source.

    Targets divide `share` of all words by weight. A target stops at twice its source's size; what is left over is
    divided again among the others, which comes to one level per unit of weight for all that don't stop.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes_by_source.withColumn("rank", F.row_number().over(order))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)
    sized = ranked.withColumn("weight", weight.cast("long")).withColumn(
        "stop", F.col("source_size") * MOST_PASSES
    )
    by_reach = W.orderBy((F.col("stop") / F.col("weight")), "rank")
    before = by_reach.rowsBetween(W.unboundedPreceding, -1)
    onward = by_reach.rowsBetween(0, W.unboundedFollowing)
    budget = F.sum("source_size").over(W.partitionBy()) * share
    levels = sized.withColumn(
        "level",
        (budget - F.coalesce(F.sum("stop").over(before), F.lit(0))) / F.sum("weight").over(onward),
    ).withColumn("place", F.row_number().over(by_reach))
    level_holds = F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.struct("place", "level"))
    final = levels.withColumn("from", F.min(level_holds).over(W.partitionBy()))
    return final.select(
        "source",
        "source_size",
        "rank",
        F.when(F.col("place") < F.col("from.place"), F.col("stop").cast("double"))
        .otherwise(F.col("from.level") * F.col("weight"))
        .alias("target"),
    )


def _queued(rows: DataFrame, offsets: DataFrame, digits: int) -> DataFrame:
    """Rows with their source's words up to and with each (`cum`), and the source's figures."""
    ranged = rows.withColumn("range", _range(F.col("key"), digits))
    order = W.partitionBy("source_key", "range").orderBy("key", "size")
    within = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    joined = ranged.withColumn("within", within).join(offsets, ["source_key", "range"])
    return joined.withColumn("cum", F.col("within") + F.col("ahead"))


def _range(key: Column, digits: int) -> Column:
    return F.floor(key / F.lit(16 ** (KEY_DIGITS - digits))).cast("long")


def _finish(turn: int) -> Column:
    total = F.col("cum") + F.lit(turn) * F.col("source_size")
    return F.when(F.col("target") > 0, total / F.col("target"))


def fair_queue_mix(
    docs: DataFrame,
    size: Column,
    doc_id: str = "doc_id",
    source: str = "source",
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    range_rows: int = RANGE_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """All columns and size, source_size, target, taken (words, repeats counted), finish; sorted by finish time.

    Every document is returned; those with `taken` = 0 are not in the mix. Result columns replace input columns of
    the same name.
    """
    names = docs.columns
    base = docs.select(
        whole(docs).alias("d"),
        # One text per source, with a mark that sets null apart from every name.
        F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")).alias("source_key"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"),
    ).withColumn("key", shuffle_key(F.col("d").getField(doc_id), F.col("source"), F.col("size")))
    narrow = settle(base.select("source_key", "source", "size", "key"), "mix-sizes")

    n = narrow.count()
    digits = max(0, math.ceil(math.log(max(1, n) / range_rows, 16))) if n > range_rows else 0
    ranges = narrow.groupBy("source_key", "source", _range(F.col("key"), digits).alias("range")).agg(
        F.sum("size").alias("words")
    )
    ranges = settle(ranges, "mix-ranges")
    goals = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share)
    prior = W.partitionBy("source_key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = settle(
        ranges.withColumn("ahead", F.coalesce(F.sum("words").over(prior), F.lit(0)))
        .join(goals.withColumnRenamed("source", "goal_of"), F.col("source").eqNullSafe(F.col("goal_of")))
        .select("source_key", "range", "ahead", "source_size", "rank", "target"),
        "mix-offsets",
    )

    cut = _cut(_queued(narrow, offsets, digits), math.floor(share * (ranges.agg(F.sum("words")).first()[0] or 0)),
               max(64, n // slice_rows))
    queued = _queued(base, offsets, digits)
    taken = sum((_taken(turn, cut) for turn in range(1, MOST_PASSES)), _taken(0, cut))
    mixed = queued.select(
        "d", "size", "source_size", "target", taken.alias("taken"), _finish(0).alias("finish"), "rank", "cum", "key"
    ).orderBy("finish", "rank", "cum", "key")
    return unpacked(mixed, "d", names, ADDED)


def _cut(queued: DataFrame, budget: int, slices: int) -> tuple | None:
    """The entry at which the budget is spent and the words it may still give: one row, for whatever input."""
    turns = F.explode(F.array(*[F.struct(F.lit(t).alias("turn"), _finish(t).alias("finish")) for t in range(MOST_PASSES)]))
    entries = queued.filter("size > 0").select("size", "rank", "cum", turns.alias("e")).select(
        "size", "rank", "cum", "e.turn", "e.finish"
    ).withColumn("slice", F.least(F.floor(F.col("finish") * slices), F.lit(4 * slices)))
    sums = entries.groupBy("slice").agg(F.sum("size").alias("words"))
    running = F.sum("words").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, W.currentRow))
    spent = sums.withColumn("upto", running).filter(F.col("upto") >= budget).orderBy("slice").first()
    if spent is None or budget <= 0:
        return None
    inner = entries.filter(F.col("slice") == spent["slice"])
    order = W.orderBy("finish", "rank", "cum", "turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = F.sum("size").over(order) + (spent["upto"] - spent["words"])
    row = inner.withColumn("upto", upto).filter(F.col("upto") >= budget).orderBy("upto").first()
    return row["finish"], row["rank"], row["cum"], row["turn"], budget - (row["upto"] - row["size"])


def _taken(turn: int, cut: tuple | None) -> Column:
    """Words that one pass takes of a document: all before the cut, the rest of the budget at it, none after."""
    if cut is None:
        return F.lit(0).cast("long")
    *at, rest = cut
    here = F.struct(_finish(turn).alias("f"), F.col("rank").alias("r"), F.col("cum").alias("c"), F.lit(turn).alias("t"))
    there = F.struct(F.lit(at[0]).cast("double").alias("f"), F.lit(at[1]).cast("int").alias("r"),
                     F.lit(at[2]).cast("long").alias("c"), F.lit(at[3]).cast("int").alias("t"))
    return (
        F.when(F.col("size") == 0, F.lit(0))
        .when(here < there, F.col("size"))
        .when(here == there, F.lit(rest))
        .otherwise(F.lit(0))
        .cast("long")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix: documents that are taken, in the order of their first finish time, with the mix's columns."""
    return fair_queue_mix(docs, sizes(F.col("text"))).filter("taken > 0")
