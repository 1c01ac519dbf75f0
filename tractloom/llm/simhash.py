"""Near duplicates by SimHash, found with pivot distance tables.

A pivot table holds the Hamming distances of a fingerprint to reference fingerprints. If two fingerprints differ in at
most 4 bits, none of their distances to a reference differs by more than 4, and none of their distances within a
block of bits does either. Two kinds of references follow:

* For every block of bits, references that differ from the zero reference in one bit of the block. Differences of
  their distances are the block's bits. With k blocks, two fingerprints within 4 bits agree in all distances of at
  least k - 4 blocks, so agreeing on these is a join key that loses no pair.
* Fixed random references over all 64 bits. Pairs that meet under a key are discarded if the largest difference of
  their distances exceeds 4, and only survivors are compared bit by bit.

Equal fingerprints are one node. Under a key, members are taken in order; a member within 4 bits of an earlier
leader is linked to it at once, so a dense group yields one link per member and not all its pairs. Keys with very
many members are cut into tiles that cover all pairs of slices. Components are found by drawing linked nodes
together with pointer jumping; a round at least halves the nodes, and rounds go on until no link is left.

Nulls and odd input: a null or empty text has fingerprint zero and is linked like any other; a null id is no
smallest id unless all are null; repeated rows share a component; empty tables stay empty. Texts of any length are
read whole, within their own row. A bit set in exactly half the hashes is 0. Of rows with a component's smallest id
one stays. Added columns replace input columns of the same name; all others pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractloom.llm.common import col, settle, unpacked, whole

SHINGLE = 4
SEED = 42
MAX_BITS = 4
REFERENCES = 32
#: Most members of a key in one task, and its share of them when it is cut into tiles.
TILE = 4_096


def fingerprint(text: bytes | None) -> int:
    """64 bits; each is 1 if more than half of the shingles' hashes have it."""
    words = text.lower().split() if text else []  # bytes: only A-Z change, only the six white space bytes split
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    view = memoryview(joined)
    digest = xxhash.xxh64_intdigest
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    hashes = [digest(view[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(n, 8)
    for at in range(0, n, 8192):  # bounded memory for very long texts
        counts += np.unpackbits(raw[at : at + 8192], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in text], np.uint64).view(np.int64))


def fingerprints(text: Column) -> Column:
    return _fingerprints(F.coalesce(text, F.lit("")).cast("binary"))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def block_bounds(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of each block of bits."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def blocks_for(n: int) -> int:
    """So many blocks that a key is shared by few of n unrelated fingerprints; every choice finds the same pairs."""
    for blocks in range(5, 9):
        bits = 64 * (blocks - MAX_BITS) // blocks
        if n <= 4 << bits:
            return blocks
    return 9


def block_keys(fp: Column, blocks: int) -> Column:
    """For each choice of blocks - 4 blocks, a hash of the choice and the distances within these blocks.

    Distances of a block to the zero reference and to those with one bit set determine the block's bits, and are
    kept in that form.
    """
    bounds = block_bounds(blocks)
    parts = [
        F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")) for shift, width in bounds
    ]
    keys = []
    for i, chosen in enumerate(combinations(range(blocks), blocks - MAX_BITS)):
        width = sum(bounds[c][1] for c in chosen)
        packed = F.lit(0).cast("long")
        for c in chosen:
            packed = F.shiftleft(packed, bounds[c][1]).bitwiseOR(parts[c])
        keys.append(F.struct(F.lit(i).cast("short").alias("choice"), packed.alias("bits")))
        assert width < 63
    return F.array(*keys)


def references(count: int = REFERENCES) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, count, np.uint64)


def pivot_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Distances to every reference, one row per fingerprint."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def links(fps: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever is connected within these distinct fingerprints by links of at most 4 bits.

    Leaders are taken one by one, and what lies within reach of a leader is linked to it. Groups of two leaders can
    only touch if the leaders are within three times the reach; such groups are compared until they are connected.
    """
    n = len(fps)
    label = np.full(n, -1)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    leaders = []
    for i in range(n):
        if label[i] >= 0:
            continue
        rest = np.flatnonzero(label[i:] < 0) + i
        near = rest[_near(fps, table, i, rest, MAX_BITS)]
        label[near] = len(leaders)
        leaders.append(i)
        left.append(np.full(len(near) - 1, i))
        right.append(near[near != i])
    root = list(range(len(leaders)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    heads = np.array(leaders)
    members = np.split(np.argsort(label, kind="stable"), np.cumsum(np.bincount(label, minlength=len(heads)))[:-1])
    for i in range(len(heads) - 1):
        later = np.arange(i + 1, len(heads))
        for j in later[_near(fps, table, heads[i], heads[i + 1 :], 3 * MAX_BITS)]:
            if find(i) == find(j):
                continue
            few, many = sorted((members[i], members[j]), key=len)
            for a in few:
                touching = many[_near(fps, table, a, many, MAX_BITS)]
                if len(touching):
                    left.append(np.array([a]))
                    right.append(touching[:1])
                    root[find(i)] = find(j)
                    break
    return np.concatenate(left).astype(int), np.concatenate(right).astype(int)


def _near(fps: np.ndarray, table: np.ndarray, i: int, others: np.ndarray, reach: int) -> np.ndarray:
    """Which of the others lie within reach: pivot distances first, then the bits of the survivors."""
    ok = np.abs(table[others] - table[i]).max(axis=1) <= reach
    ok[ok] = np.bitwise_count(fps[others[ok]] ^ fps[i]) <= reach
    return ok


def linked_runs(group: np.ndarray, fps: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal group numbers: pairs at each distance in the run at once, large runs by leaders."""
    table = pivot_table(fps, refs)
    bounds = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    sizes = np.diff(bounds)
    left, right = [], []
    large = np.repeat(sizes > 64, sizes)
    for step in range(1, int(sizes[sizes <= 64].max(initial=1))):
        a = np.flatnonzero((group[:-step] == group[step:]) & ~large[:-step])
        b = a + step
        ok = np.abs(table[a] - table[b]).max(axis=1, initial=0) <= MAX_BITS
        ok[ok] = np.bitwise_count(fps[a[ok]] ^ fps[b[ok]]) <= MAX_BITS
        left.append(a[ok])
        right.append(b[ok])
    for at, size in zip(bounds[:-1][sizes > 64], sizes[sizes > 64], strict=True):
        a, b = links(fps[at : at + size], table[at : at + size])
        left.append(a + at)
        right.append(b + at)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


def _link_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows (choice, bits, tile, fp) to links; a run that a batch cuts waits for the next batch."""
    refs = references()
    names = ["choice", "bits", "tile"]
    held: pd.DataFrame | None = None

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        keys = rows[names].to_numpy()
        group = np.r_[0, np.cumsum((keys[1:] != keys[:-1]).any(axis=1))]
        fps = rows["fp"].to_numpy().view(np.uint64)
        a, b = linked_runs(group, fps, refs)
        signed = fps.view(np.int64)
        return pd.DataFrame({"a": np.minimum(signed[a], signed[b]), "b": np.maximum(signed[a], signed[b])})

    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        keys = rows[names].to_numpy()
        last = np.flatnonzero((keys != keys[-1]).any(axis=1))
        cut = last[-1] + 1 if len(last) else 0
        held = rows.iloc[cut:].reset_index(drop=True)
        if cut:
            yield linked(rows.iloc[:cut].reset_index(drop=True))
    if held is not None and len(held):
        yield linked(held)


def fingerprint_links(unique: DataFrame, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that connect all that 4 bits or fewer connect."""
    blocks = blocks or blocks_for(unique.count())
    keyed = unique.select("fp", F.explode(block_keys(F.col("fp"), blocks)).alias("k")).select(
        "fp", "k.choice", "k.bits"
    )
    shared = keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = keyed.join(shared, ["choice", "bits"])
    slices = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    tiled = members.withColumn("slices", slices).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    )
    placed = tiled.select(
        "choice",
        "bits",
        (F.least("own", "other").cast("long") * F.col("slices") + F.greatest("own", "other")).alias("tile"),
        "fp",
    )
    parts = int(unique.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartition(parts, "choice", "bits", "tile").sortWithinPartitions("choice", "bits", "tile", "fp")
    return ordered.mapInPandas(_link_groups, "a long, b long").distinct()


def components(links_between: DataFrame) -> DataFrame:
    """(fp, root) for every linked fingerprint: the smallest that can be reached.

    In every round each node takes its smallest neighbour, lower or not, as parent. As a neighbour's choice is never
    larger than the node itself, only two nodes can choose each other; the smaller one of these is a root. Pointer
    jumping turns the trees into stars, and links are drawn between their roots. Every node joins another, so at
    least half of the nodes go in a round, whatever the order of their numbers; it ends when no link is left.
    """
    links = settle(links_between, "links")
    labels = None
    while links.limit(1).count():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        chosen = settle(both.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("next")), "chosen")
        back = chosen.select(F.col("of").alias("met"), F.col("next").alias("back"))
        mutual = (F.col("back") == F.col("of")) & (F.col("of") < F.col("next"))
        roots = _jumped(
            chosen.join(back, F.col("next") == F.col("met")).select(
                "of", F.when(mutual, F.col("of")).otherwise(F.col("next")).alias("root")
            )
        )
        if labels is None:
            labels = roots.withColumnRenamed("of", "fp")
        else:
            later = roots.withColumnRenamed("root", "later")
            labels = settle(
                labels.join(later, F.col("root") == F.col("of"), "left").select(
                    "fp", F.coalesce("later", "root").alias("root")
                ),
                "labels",
            )
        ends = [roots.select(F.col("of").alias(f"{x}_of"), F.col("root").alias(f"{x}_root")) for x in "ab"]
        between = links.join(ends[0], F.col("a") == F.col("a_of")).join(ends[1], F.col("b") == F.col("b_of"))
        links = settle(
            between.filter("a_root <> b_root")
            .select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
            .distinct(),
            "links",
        )
    if labels is None:
        return links.select(F.col("a").alias("fp"), F.col("b").alias("root"))
    least = labels.groupBy(F.col("root").alias("of")).agg(F.min("fp").alias("least"))
    return settle(labels.join(least, F.col("root") == F.col("of")).select("fp", F.col("least").alias("root")), "labels")


def _jumped(parents: DataFrame) -> DataFrame:
    """Settled (of, root): every node's last ancestor. Roots are their own parents; a jump halves all distances."""
    while True:
        parents = settle(parents, "parents")
        up = parents.select(F.col("of").alias("met"), F.col("root").alias("up"))
        further = parents.join(up, F.col("root") == F.col("met"))
        if not further.filter("up <> root").limit(1).count():
            return parents
        parents = further.select("of", F.col("up").alias("root"))


def fingerprinted(docs: DataFrame, text: str, doc_id: str, carried: list[str]) -> DataFrame:
    """Settled: `d` (the carried columns), id, fp, row (a number of its own)."""
    return settle(
        docs.select(
            whole(docs.select(*map(col, carried))).alias("d") if carried else F.struct(F.lit(0).alias("none")).alias("d"),
            col(doc_id).alias("id"),
            fingerprints(col(text)).alias("fp"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "fingerprints",
    )


def classes(printed: DataFrame, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """(fp, component_id, first): of every fingerprint, the smallest id of its component and its first row."""
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row"))
    unique = settle(printed.groupBy("fp").agg(F.min("id").alias("least"), first.alias("first")), "unique")
    roots = components(fingerprint_links(unique, tile, blocks)).withColumnRenamed("fp", "linked")
    rooted = unique.join(roots, F.col("fp") == F.col("linked"), "left").select(
        "fp", "least", "first", F.coalesce("root", "fp").alias("root")
    )
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("first"))
    return rooted.select("fp", "root").join(lowest, "root").select("fp", "component_id", "first")


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    carried: list[str] | None = None,
    tile: int = TILE,
    blocks: int | None = None,
) -> DataFrame:
    """The carried columns (all, unless named), fingerprint (16 hexadecimal digits) and component_id."""
    names = docs.columns if carried is None else carried
    printed = fingerprinted(docs, text, doc_id, names)
    found = classes(printed, tile, blocks).select(F.col("fp").alias("of"), "component_id")
    joined = printed.join(found, F.col("fp") == F.col("of")).select(
        "d", hex_digits(F.col("fp")).alias("fingerprint"), "component_id"
    )
    return unpacked(joined, "d", names, ["fingerprint", "component_id"])


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id, with its own columns only."""
    printed = fingerprinted(docs, "text", "doc_id", docs.columns)
    kept = classes(printed).select(F.col("first.row").alias("row")).distinct()
    return unpacked(printed.join(kept, "row", "leftsemi"), "d", docs.columns)
