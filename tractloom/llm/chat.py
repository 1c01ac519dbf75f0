"""Multi-party dialogues, once from the view of every participant.

For each participant the dialogue is rendered with that speaker as the assistant and everyone else as a user named
after their role; the mask holds the spans of the speaker's own text. System turns belong to nobody.

Long dialogues come in parts of `PART` turns, counted from 0 in the dialogue's order, so that no row holds an unbounded
group; how turns are numbered doesn't matter. Every participant of a dialogue gets every part, with an empty mask where
they are silent. Concatenating a speaker's parts by `part` gives their view of the whole dialogue.

Turns get their places from a global sort by dialogue and turn in ranges, which is settled: places within a range are
counted there, and a dialogue that goes through several ranges adds up their sizes. A dialogue with most of all rows so
is the work of many tasks, as is its meeting with its participants, block by block of parts.

Nulls and odd input: rows without a conversation id have nothing that ties them together, each is a dialogue of its
own; a null turn comes last; a null role is the speaker `unknown`; null texts are empty; turns with one number follow
each other by role and text; equal rows appear as often as they occur; a dialogue of system turns alone has no
participant and so no row; a turn's text is never cut, however long; other columns are ignored, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tractloom.llm.common import col, settle

PART = 64
#: Parts that meet a dialogue's participants in one place.
BLOCK = 16
#: Copies of a row that are listed at once.
COPIES = 4096
SYSTEM = "system"
START, END = "<|start|>", "<|end|>\n"

_ORDER = ["late", "turn", "role", "text"]


def ranged_turns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Distinct turns with their number of copies, sorted by dialogue and order into numbered ranges."""
    rows = turns.select(
        col(conv).alias("conv"),
        col(turn).isNull().alias("late"),
        col(turn).cast("long").alias("turn"),
        F.coalesce(col(role), F.lit("unknown")).alias("role"),
        F.coalesce(col(text), F.lit("")).alias("text"),
    )
    # Equal rows are counted before they move.
    counted = rows.groupBy("conv", *_ORDER).agg(F.count(F.lit(1)).alias("copies"))
    return settle(counted.repartitionByRange("conv", *_ORDER).withColumn("range", F.spark_partition_id()), "turns")


def parts(ranged: DataFrame) -> DataFrame:
    """One row per part of a dialogue with its turns in order."""
    sizes = ranged.filter(F.col("conv").isNotNull()).groupBy("conv", "range").agg(F.sum("copies").alias("n"))
    ahead = W.partitionBy("conv").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("conv", "range", F.sum("n").over(ahead).alias("start")).filter("start IS NOT NULL")
    within = W.partitionBy("conv", "range").orderBy(*_ORDER).rowsBetween(W.unboundedPreceding, -1)
    numbered = ranged.withColumn("before", F.coalesce(F.sum("copies").over(within), F.lit(0)))
    alone = F.col("conv").isNull()
    place = F.coalesce("start", F.lit(0)) + F.col("before") + F.col("copy")
    last = F.col("copies") - 1
    each = (
        numbered.join(starts, ["conv", "range"], "left")
        .withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(COPIES).cast("long"))))
        .withColumn("copy", F.explode(F.sequence("from", F.least(F.col("from") + (COPIES - 1), last))))
    )
    placed = each.select(
        "conv",
        F.when(alone, F.lit(0)).otherwise(F.floor(place / PART)).cast("long").alias("part"),
        # What makes a row without an id a dialogue of its own.
        F.when(alone, F.struct("turn", "role", "text", "copy")).alias("own"),
        F.struct(*_ORDER, "copy").alias("t"),
    )
    return placed.groupBy("conv", "part", "own").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def participants(ranged: DataFrame) -> DataFrame:
    """(of, of_spread, participant): who speaks anywhere in a dialogue, system turns aside, for each block of parts."""
    known = ranged.filter(F.col("conv").isNotNull())
    lengths = known.groupBy("conv").agg(F.sum("copies").alias("n"))
    who = known.filter(F.col("role") != SYSTEM).select("conv", F.col("role").alias("participant")).distinct()
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / (PART * BLOCK)))
    return who.join(lengths, "conv").select(F.col("conv").alias("of"), F.explode(blocks).alias("of_spread"), "participant")


def _said(turn: Column, speaker: Column) -> list[Column]:
    """Header, text and end of a turn as `speaker` sees it."""
    header = (
        F.when(turn["role"] == SYSTEM, F.lit(START + SYSTEM + "\n"))
        .when(turn["role"] == speaker, F.lit(START + "assistant\n"))
        .otherwise(F.concat(F.lit(START + "user name="), turn["role"], F.lit("\n")))
    )
    return [header, turn["text"], F.lit(END)]


def perspectives(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """conv_id, speaker, part, n_turns, n_own, rendered, mask (spans of the speaker's text, code points)."""
    ranged = ranged_turns(turns, conv, turn, role, text)
    # Rows without an id meet nobody; they are spread so that they don't become one heap.
    alone = F.col("conv").isNull()
    spread = parts(ranged).withColumn("spread", F.when(alone, F.xxhash64("own")).otherwise(F.floor(F.col("part") / BLOCK)))
    told_by = participants(ranged)
    met = (F.col("conv") == F.col("of")) & (F.col("spread") == F.col("of_spread"))
    views = (
        spread.join(told_by, met, "left")
        .withColumn("speaker", F.when(alone, F.col("own.role")).otherwise(F.col("participant")))
        .filter(F.col("speaker").isNotNull() & ~(alone & (F.col("speaker") == SYSTEM)))
    )
    who = F.col("speaker")
    told = views.select(
        F.col("conv").alias(conv), "speaker", "part", "turns",
        F.transform("turns", lambda t: F.concat(*_said(t, who))).alias("pieces"),
    )
    # Where each piece begins: lengths summed up to it.
    begins = F.transform(
        "pieces",
        lambda p, i: F.aggregate(F.slice("pieces", F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x)),
    )
    spots = told.withColumn("begins", begins)
    own = F.filter(
        F.transform(
            "turns",
            lambda t, i: F.struct(
                t["role"].alias("role"),
                (F.get("begins", i) + F.length(F.lit(START + "assistant\n"))).alias("start"),
                (F.get("begins", i) + F.length(F.lit(START + "assistant\n")) + F.length(t["text"])).alias("end"),
            ),
        ),
        lambda s: s["role"] == who,
    )
    return spots.select(
        conv, "speaker", "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(own).cast("long").alias("n_own"),
        F.array_join("pieces", "").alias("rendered"),
        F.transform(own, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("mask"),
    )
