"""Benchmark passages in documents, found by one Aho-Corasick automaton over word windows.

Benchmark texts are normalised to words; every window of 13 consecutive words, or the whole of a shorter item, is a
pattern. A document is normalised the same way and runs through the automaton once, word by word. Each match gives a
range of words, whose offsets in the original text are known because normalising keeps every byte's place.

The automaton has a bounded size: a benchmark beyond `PART_CHARS` characters is cut into parts, and documents pass
the parts one after the other, settled in between. Long items are cut into overlapping pieces first, so that a
part's size is bounded whatever a single item holds.

Nulls and odd input: null texts have no words; items without words are never found; an item without an id counts as
one with an empty id; ids that occur on several rows count once; empty tables are fine.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractloom.llm.common import settle, unpacked, whole

WINDOW = 13
#: Characters of benchmark text in one automaton.
PART_CHARS = 2_000_000
PIECE_WORDS = 5_000
#: A document is contaminated when at least one word in so many is hit.
SHARE = 20

#: Byte by byte: A-Z to a-z, digits, a-z and everything outside ASCII kept, the rest to blanks.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_RUN = re.compile(rb"[^ ]+")
UNKNOWN = "\x01"

HITS = "n_words long, n_hit long, items array<string>, ranges array<int>, spans array<struct<start:int,end:int>>"


def normal_words(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


def _letter(k: int) -> str:
    """The k-th word of a vocabulary as one character; surrogates are skipped."""
    k += 2
    return chr(k if k < 0xD800 else k + 0x800)


class Patterns:
    """The automaton of some items, given as (id, words)."""

    def __init__(self, items: list[tuple[str, list[bytes]]]) -> None:
        self.letters: dict[bytes, str] = {}
        found: dict[str, set[str]] = {}
        for item, words in items:
            text = "".join(self.letters.setdefault(w, _letter(len(self.letters))) for w in words)
            for i in range(max(1, len(text) - WINDOW + 1)):
                if pattern := text[i : i + WINDOW]:
                    found.setdefault(pattern, set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for pattern, ids in found.items():
            self.automaton.add_word(pattern, (len(pattern), tuple(ids)))
        self.empty = not found
        if found:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges inside occurrences (end exclusive, merged) and the ids found."""
        if self.empty or not words:
            return [], set()
        get = self.letters.get
        ranges: list[tuple[int, int]] = []
        ids: set[str] = set()
        for end, (size, items) in self.automaton.iter("".join([get(w, UNKNOWN) for w in words])):
            ids.update(items)
            ranges.append((end + 1 - size, end + 1))
        return merged(ranges), ids


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def offsets(text: bytes, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Code point offsets in the original text of ranges of words."""
    bounds = [m.span() for m in _RUN.finditer(text.translate(NORMAL))]
    out, at, points = [], 0, 0
    for s, e in ranges:
        span = []
        for byte in (bounds[s][0], bounds[e - 1][1]):
            points += len(text[at:byte].decode("utf-8", "replace"))
            at = byte
            span.append(points)
        out.append({"start": span[0], "end": span[1]})
    return out


def pieces(items: DataFrame) -> DataFrame:
    """(item, words, size): distinct items' words, long ones in pieces that share a window's worth of words."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item"], batch["body"], strict=True):
                words = normal_words(text)
                for i in range(0, max(1, len(words) - WINDOW + 1), PIECE_WORDS):
                    if piece := words[i : i + PIECE_WORDS + WINDOW - 1]:
                        rows.append((item, b" ".join(piece)))
            yield pd.DataFrame(rows, columns=["item", "piece"])

    return items.distinct().mapInPandas(cut, "item string, piece binary")


def scanner(items: list[tuple[str, list[bytes]]]):  # noqa: ANN201
    """A UDF from text and what earlier parts found to the findings so far."""
    cache: list[Patterns] = []

    def scan(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        if not cache:
            cache.append(Patterns(items))
        patterns = cache[0]
        for texts, before_ranges, before_items in batches:
            rows = []
            for text, old, ids in zip(texts, before_ranges, before_items, strict=True):
                words = normal_words(text)
                ranges, found = patterns.scan(words)
                if len(old):
                    ranges = merged([*ranges, *zip(old[::2], old[1::2], strict=True)])
                found |= set(ids)
                rows.append(
                    (
                        len(words),
                        sum(e - s for s, e in ranges),
                        sorted(found),
                        [int(x) for r in ranges for x in r],
                        offsets(text, ranges) if ranges else [],
                    )
                )
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "ranges", "spans"])

    return F.pandas_udf(scan, HITS)


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """All columns of `docs` and n_words, n_hit, items (ids, sorted), spans (code points), contaminated.

    These replace input columns of the same name.
    """
    names = docs.columns
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col(item_text), F.lit("")).cast("binary").alias("body"),
    )
    cut = settle(pieces(items), "benchmark")
    total = cut.agg(F.sum(F.length("piece"))).first()[0] or 0
    parts = max(1, -(-total // part_chars))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("item", "piece"), F.lit(parts)))
    hits = docs.select(
        whole(docs).alias("d"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"),
        F.array().cast("array<int>").alias("ranges"),
        F.array().cast("array<string>").alias("items"),
    )
    for part in range(parts):
        if part:
            hits = settle(hits, "decontaminate")
        known = [(r["item"], bytes(r["piece"]).split()) for r in cut.filter(F.col("part") == part).collect()]
        found = hits.withColumn("h", scanner(known)("body", "ranges", "items"))
        hits = found.select("d", "body", "h.ranges", "h.items", "h.n_words", "h.n_hit", "h.spans")
    judged = hits.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))
    return unpacked(judged, "d", names, ["n_words", "n_hit", "items", "spans", "contaminated"])


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that are not contaminated, with their own columns only."""
    marked = benchmark_hits(docs.select(whole(docs).alias("doc"), "text"), benchmark)
    return unpacked(marked.filter(~F.col("contaminated")), "doc", docs.columns)
