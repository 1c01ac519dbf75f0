"""URL rules and a Bloom filter cascade for host lists.

A cascade holds a set exactly, over a known universe of keys: level 1 is a Bloom filter of the listed keys, level 2
of the unlisted keys that level 1 lets through, level 3 of the listed keys that level 2 lets through, and so on until
none is left. Its levels are small arrays of bits, built by grouped bit_or and read as scalar subqueries; asking it
is an expression in the scan, without a join. Every hash is salted before it reads the key, so that keys that meet in
one hash part in the next; should some still be together after many levels, they are told apart by name. A list too long
for levels that can be copied becomes several cascades, each over the keys of one hash, which are asked one after the
other about the rows of theirs.

Nulls and odd input: a null url, or one without `://`, has an empty host and path and no rule fits it; the empty host
is a key like any other; null keys are in no list; empty lists and empty tables are fine; repeated rows are judged
alike.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractloom.llm.common import ascii_lower, col, settle, unpacked, whole

#: (verdict, host, path): a rule fits its host and all subdomains if the url's path starts with the rule's.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A cascade is copied to every task, so its first level may have about this many bits; a longer list is split by hash.
MAX_BITS = 1 << 27
#: Levels halve what is undecided, so that after so many none is left but by a chance of 2 ** -37 for 2 ** 27 keys.
MAX_LEVELS = 64


def host_and_path(url: Column) -> list[Column]:
    """Between `://` and the first of `/?#`, in lower case; then up to `?` or `#`. Empty if there is no `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return [ascii_lower(host).alias("host"), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path")]


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, the first by code point among equally long ones."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    kind = "struct<rule:string,verdict:string>"
    chosen = F.lit(None).cast(kind)
    for verdict, rule_host, rule_path in reversed(ordered):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        hit = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, hit).otherwise(chosen)
    return chosen.cast(kind)


class Levels:
    """One cascade: `known` has the universe's distinct keys and whether each is `listed`; `rate` is the first level's."""

    def __init__(self, known: DataFrame, rate: float, max_levels: int) -> None:
        self.levels: list[tuple[DataFrame, int, int]] = []
        self.rest: DataFrame | None = None
        left = known.filter("listed").select("key")
        passed = left.count()
        while passed:
            if len(self.levels) == max_levels:
                self.rest = settle(left.agg(F.collect_set("key").alias("keys")), "rest")
                break
            self.levels.append(self._level(left, passed, rate))
            other = known.filter(~F.col("listed") if len(self.levels) % 2 else F.col("listed"))
            left = settle(other.filter(self._passes_all(F.col("key"))).select("key"), "cascade")
            passed, rate = left.count(), 0.5

    def _level(self, keys: DataFrame, n: int, rate: float) -> tuple[DataFrame, int, int]:
        """A Bloom filter as one row with an array of 64-bit words; its number of bits; its number of hashes."""
        hashes = max(1, round(math.log2(1 / rate)))
        size = 64 * max(1, math.ceil(n * math.log2(1 / rate) * 1.4427 / 64))
        at = len(self.levels)
        spots = keys.select(F.explode(F.array(*self._spots(F.col("key"), at, size, hashes))).alias("spot"))
        some = spots.groupBy((F.col("spot") / 64).cast("long").alias("word")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("spot") % 64).cast("int"))).alias("bits")
        )
        empty = keys.sparkSession.range(size // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
        words = some.unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        row = words.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w"))
        return settle(row.select(F.transform("w", lambda x: x["bits"]).alias("bits")), "bits"), size, hashes

    @staticmethod
    def _spots(key: Column, level: int, size: int, hashes: int) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), F.lit(size)) for i in range(hashes)]

    def _in_level(self, key: Column, at: int) -> Column:
        row, size, hashes = self.levels[at]
        words = row.scalar()
        inside = F.lit(True)
        for spot in self._spots(key, at, size, hashes):
            bit = F.call_function(
                "shiftrightunsigned", F.get(words, (spot / 64).cast("int")), (spot % 64).cast("int")
            )
            inside = inside & (bit.bitwiseAND(F.lit(1).cast("long")) == 1)
        return inside

    def _passes_all(self, key: Column) -> Column:
        """What is still undecided after the levels so far: keys that every level lets through."""
        passes = F.lit(True)
        for at in range(len(self.levels)):
            passes = passes & self._in_level(key, at)
        return passes

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        inside = F.lit(False) if self.rest is None else F.array_contains(self.rest.scalar(), key)
        for at in reversed(range(len(self.levels))):
            inside = self._in_level(key, at) & ~inside
        return key.isNotNull() & F.coalesce(inside, F.lit(False))


class Cascade:
    """Exact membership of a listed set over a universe of keys; both are DataFrames with a string column `key`."""

    def __init__(
        self, universe: DataFrame, listed: DataFrame, max_bits: int = MAX_BITS, max_levels: int = MAX_LEVELS
    ) -> None:
        keys = universe.select(F.col("key").cast("string")).filter("key IS NOT NULL").distinct()
        marks = listed.select(F.col("key").cast("string")).filter("key IS NOT NULL").distinct()
        marked = keys.join(marks.withColumn("listed", F.lit(True)), "key", "left")
        known = settle(marked.select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "universe")
        total = known.agg(F.count(F.lit(1)).alias("n"), F.count_if("listed").alias("r")).first()
        inside, outside = total["r"], total["n"] - total["r"]
        # The first level's rate balances both sides; later ones halve what is left.
        rate = min(0.5, max(1e-6, math.sqrt(0.5) * inside / max(1, outside)))
        self.shards = max(1, math.ceil(inside * math.log2(1 / rate) * 1.45 / max_bits))
        if self.shards > 1:
            known = settle(known.withColumn("shard", self._shard(F.col("key"))), "shards", "shard")
        self.parts = [Levels(part, rate, max_levels) for part in self._apart(known)]

    def _shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(self.shards)).cast("int")

    def _apart(self, sharded: DataFrame) -> list[DataFrame]:
        """The rows of each shard, settled in folders of their own; all rows where there is one shard."""
        return [sharded] if self.shards == 1 else [sharded.filter(F.col("shard") == s) for s in range(self.shards)]

    def mark(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """With a boolean column. Rows of several shards are written apart and marked shard by shard, so that only one
        shard's bits are in memory at a time."""
        if self.shards == 1:
            return df.withColumn(name, self.parts[0].contains(col(key)))
        rows = df.select(whole(df).alias("row"), col(key).alias("key"), self._shard(col(key)).alias("shard"))
        marked = [
            settle(some.select("row", part.contains(F.col("key")).alias(name)), "marked")
            for some, part in zip(self._apart(settle(rows, "rows", "shard")), self.parts, strict=True)
        ]
        return unpacked(reduce(DataFrame.unionAll, marked), "row", df.columns, [name])


def judged_urls(pages: DataFrame, listed: DataFrame, url: str = "url", rules: tuple = RULES) -> DataFrame:
    """All columns and host, path, rule (null if none fits) and verdict.

    The verdict is the rule's; where no rule fits, block for listed hosts (`listed` has a column `key`), else allow.
    """
    names = pages.columns
    split = pages.select(whole(pages).alias("p"), *host_and_path(F.col(url)))
    found = split.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    marked = Cascade(split.select(F.col("host").alias("key")), listed).mark(found, "host", "is_listed")
    verdict = F.coalesce("r.verdict", F.when(F.col("is_listed"), "block").otherwise("allow"))
    out = marked.select("p", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"))
    return unpacked(out, "p", names, ["host", "path", "rule", "verdict"])


def hosts_mostly_blocked(pages: DataFrame, url: str = "url", rules: tuple = RULES) -> DataFrame:
    """A host list from the pages themselves: hosts of whose pages the rules block more than they allow."""
    split = pages.select(*host_and_path(F.col(url)))
    verdict = rule_of(F.col("host"), F.col("path"), rules)["verdict"]
    counts = split.select(F.col("host").alias("key"), verdict.alias("v")).groupBy("key").agg(
        F.count_if(F.col("v") == "block").alias("blocked"), F.count_if(F.col("v") == "allow").alias("allowed")
    )
    return counts.filter("blocked > allowed").select("key")
