"""Hard negatives: for each anchor and positive, the rows of other labels that score almost as high.

Vectors become whole numbers; a row's score is its inner product with the anchor. Anchors and candidates are dealt
into blocks of bounded size, and every anchor block meets every candidate block in a task of its own: a search of a
stated set of queries against all rows. Inside a task the two are cut by label, so that of all pairs each is
multiplied once: equal labels when the positives are searched, different ones when the negatives are. Tiles are
multiplied by Strassen's recursion on int64 with zero padding; sums wrap around like the ring of 64-bit numbers, so a
score is exact whenever it fits into 64 bits, whatever the partial sums do.

Every tile feeds heaps of fixed size: one per anchor for positives, one per anchor and positive for the window of
negatives. Heaps of different tasks are merged by Spark, which cuts each task's rows to the heap size before they move.

Nulls and odd input: rows without label, id or vector, or with a null or non-finite component, take no part. Shorter
vectors are padded with zeros; components beyond 64 bits after scaling take the nearest 64-bit number. Rows that share
the anchor's id are none of its positives. Rows that repeat another one count once each, as candidates; an anchor that is
repeated with label and vector is mined once, with another label or vector once more. Equal scores go by the smaller
id. Anchors without positives, and positives without negatives in their window, have no rows; an empty table gives
none. Columns other than the three named ones play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tractloom.llm.common import col, settle

#: Rows of an anchor block and of a candidate block; blocks are dealt by hash, so these are means.
ANCHORS = 4096
CANDIDATES = 8192
#: A tile is at most so many anchors by so many candidates.
TILE = (512, 2048)
#: The recursion stops where a side would get shorter than this.
LEAF = 8
#: A negative scores at least this share of the positive, as numerator and denominator.
LEAST = (4, 5)


# --- multiplication ----------------------------------------------------------------------------------------------


def _multiply(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    """a @ b with seven products of half size at each level; all sides are multiples of 2 ** levels."""
    if not levels:
        return a @ b
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    levels -= 1
    both = _multiply(a11 + a22, b11 + b22, levels)
    lower = _multiply(a21 + a22, b11, levels)
    right = _multiply(a11, b12 - b22, levels)
    left = _multiply(a22, b21 - b11, levels)
    upper = _multiply(a11 + a12, b22, levels)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n] = both + left - upper + _multiply(a12 - a22, b21 + b22, levels)
    out[:m, n:] = right + upper
    out[m:, :n] = lower + left
    out[m:, n:] = both - lower + right + _multiply(a21 - a11, b11 + b12, levels)
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix product of two int64 matrices, by Strassen's recursion on zero-padded copies."""
    (m, k), n = a.shape, b.shape[1]
    levels = 0
    while min(m, k, n) >> (levels + 1) >= LEAF:
        levels += 1
    unit = 1 << levels
    padded = [np.zeros([-(-side // unit) * unit for side in x.shape], np.int64) for x in (a, b)]
    padded[0][:m, :k], padded[1][:k, :n] = a, b
    return _multiply(*padded, levels)[:m, :n]


def whole_numbers(vectors: pa.ListArray, width: int, scale: float) -> np.ndarray:
    """Rows of floor(scale * component), zeros behind the shorter ones."""
    lengths = np.diff(vectors.offsets.to_numpy())
    values = np.floor(np.asarray(vectors.flatten(), np.float64) * scale)
    out = np.zeros((len(lengths), width), np.int64)
    at = np.arange(width) < lengths[:, None]
    top = 2.0**63
    fits = np.clip(values, -top, np.nextafter(top, 0)).astype(np.int64)
    out[at] = np.where(values >= top, np.iinfo(np.int64).max, fits)
    return out


# --- heaps -------------------------------------------------------------------------------------------------------


class Heaps:
    """The best entries of every key, at most `size` each: highest score first, then the smallest id."""

    def __init__(self, keys: int, size: int) -> None:
        self.size = size
        self.key, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        #: What a new entry has to beat or tie with: the worst of a full heap.
        self.worst = np.full(keys, np.iinfo(np.int64).min)

    def push(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(key):
            return
        key, score, ids = (np.concatenate(x) for x in ((self.key, key), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, ~score, key))
        key = key[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        rank = np.arange(len(key)) - np.repeat(starts, np.diff(np.r_[starts, len(key)]))
        keep = rank < self.size
        self.key, self.score, self.id = key[keep], score[order][keep], ids[order][keep]
        full = rank[keep] == self.size - 1
        self.worst[self.key[full]] = self.score[full]


def _tiles(first: slice, second: slice) -> Iterator[tuple[slice, slice]]:
    for a in range(first.start, first.stop, TILE[0]):
        for b in range(second.start, second.stop, TILE[1]):
            yield slice(a, min(a + TILE[0], first.stop)), slice(b, min(b + TILE[1], second.stop))


class Block:
    """Rows of one block in the order of their labels and ids."""

    def __init__(self, rows: pa.Table | pa.StructArray, width: int, scale: float) -> None:
        get = (lambda n: rows[n].combine_chunks()) if isinstance(rows, pa.Table) else rows.field
        self.label, self.id = np.asarray(get("label"), np.int64), np.asarray(get("id"), np.int64)
        self.order = np.lexsort((self.id, self.label))
        vectors = get("vector")
        vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
        self.vectors = whole_numbers(vectors, width, scale)[self.order]
        self.label, self.id = self.label[self.order], self.id[self.order]

    def of(self, label: int) -> slice:
        return slice(*(int(np.searchsorted(self.label, label, side)) for side in ("left", "right")))


def _scores(anchors: Block, rows: Block, same: bool) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Tiles of scores between rows of the same label, or between those of different ones."""
    turned = np.ascontiguousarray(rows.vectors.T)
    for label in np.unique(anchors.label):
        own, alike = anchors.of(label), rows.of(label)
        parts = [alike] if same else [slice(0, alike.start), slice(alike.stop, len(rows.id))]
        for part in parts:
            for a, b in _tiles(own, part):
                yield a, b, product(anchors.vectors[a], turned[:, b])


def _width(*vectors) -> int:  # noqa: ANN002
    return max([0, *(int(np.diff(v.offsets.to_numpy()).max()) for v in vectors if len(v))])


def _blocks(left: pa.Table, right: pa.Table, scale: float) -> tuple[pa.StructArray, Block, Block] | None:
    if not len(left) or not len(right):
        return None
    anchors = left["anchors"].combine_chunks().flatten()
    rows = right.combine_chunks()
    vectors = rows["vector"].chunk(0)
    width = _width(anchors.field("vector"), vectors)
    return anchors, Block(anchors, width, scale), Block(rows, width, scale)


def _best_positives(left: pa.Table, right: pa.Table, scale: float, most: int) -> pa.Table:
    """Heaps of one anchor block over one candidate block: (no, score, id)."""
    heaps, numbers = Heaps(0, most), np.empty(0, np.int64)
    if found := _blocks(left, right, scale):
        struct, anchors, rows = found
        numbers = np.asarray(struct.field("no"), np.int64)[anchors.order]
        heaps = Heaps(len(numbers), most)
        for a, b, scores in _scores(anchors, rows, True):
            good = scores >= heaps.worst[a][:, None]
            good &= anchors.id[a][:, None] != rows.id[b]
            i, j = np.nonzero(good)
            heaps.push(i + a.start, scores[i, j], rows.id[b][j])
    return pa.table({"no": numbers[heaps.key], "score": heaps.score, "id": heaps.id})


def lowest(positive: np.ndarray) -> np.ndarray:
    """The least whole number that is at least LEAST of the score, without leaving 64 bits."""
    up, down = LEAST
    parts, rest = np.divmod(positive, down)
    return parts * up - (-rest * up // down)


def _best_negatives(left: pa.Table, right: pa.Table, scale: float, most: int) -> pa.Table:
    """Heaps of one anchor block's windows over one candidate block: (no, place of the positive, score, id)."""
    heaps, numbers, width = Heaps(0, most), np.empty(0, np.int64), 1
    if found := _blocks(left, right, scale):
        struct, anchors, rows = found
        numbers = np.asarray(struct.field("no"), np.int64)[anchors.order]
        lists = struct.field("positives").take(pa.array(anchors.order))
        lengths = np.diff(lists.offsets.to_numpy())
        width = max(1, int(lengths.max()))
        high = np.full((len(numbers), width), -1, np.int64)
        low = np.zeros((len(numbers), width), np.int64)  # empty windows where there is no positive
        high[np.arange(width) < lengths[:, None]] = np.asarray(lists.flatten().field("score"), np.int64)
        real = np.arange(width) < lengths[:, None]
        low[real] = lowest(high[real])
        heaps = Heaps(len(numbers) * width, most)
        for a, b, scores in _scores(anchors, rows, False):
            for place in range(width):
                keys = np.arange(a.start, a.stop) * width + place
                least = np.maximum(low[a, place], heaps.worst[keys])
                i, j = np.nonzero((scores >= least[:, None]) & (scores <= high[a, place][:, None]))
                heaps.push(keys[i], scores[i, j], rows.id[b][j])
    return pa.table(
        {"no": numbers[heaps.key // width], "place": (heaps.key % width).astype(np.int32), "score": heaps.score,
         "id": heaps.id}
    )


# --- the search --------------------------------------------------------------------------------------------------


def _dealt(row: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(blocks)).cast("int")


def _first(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Merged heaps: the best rows of every key, ranked from 1."""
    order = W.partitionBy(*keys).orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _search(anchors: DataFrame, rows: DataFrame, find, blocks: tuple[int, int], kind: str) -> DataFrame:  # noqa: ANN001
    """`find` over every anchor block and candidate block."""
    a, b = blocks
    packed = anchors.groupBy(_dealt(F.col("no"), a).alias("a")).agg(
        F.collect_list(F.struct(*anchors.columns)).alias("anchors")
    )
    left = packed.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(b - 1)))).groupBy("a", "b")
    spread = rows.withColumn("b", _dealt(F.col("row"), b))
    right = spread.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(a - 1)))).groupBy("a", "b")
    return left.cogroup(right).applyInArrow(find, kind)


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: float = 256.0,
    positives: int = 5,
    negatives: int = 5,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    A negative's score lies between LEAST of the positive's and the positive's.
    """
    finite = F.forall(col(vector), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    kept = rows.select(
        col(vec_id).cast("long").alias("id"), col(label).cast("long").alias("label"),
        col(vector).alias("vector"), is_anchor.alias("asks"),
        finite.alias("finite"),
    )
    kept = kept.filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND finite")
    known = settle(kept.select("id", "label", "vector", "asks", F.monotonically_increasing_id().alias("row")), "vectors")
    asking = known.filter("asks").groupBy("id", "label", "vector").agg(F.min("row").alias("no"))
    asking = settle(asking, "anchors")
    blocks = (max(1, -(-asking.count() // ANCHORS)), max(1, -(-known.count() // CANDIDATES)))
    others = known.select("id", "label", "vector", "row")

    def find_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        return _best_positives(left, right, scale, positives)

    def find_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        return _best_negatives(left, right, scale, negatives)

    near = _first(_search(asking, others, find_positives, blocks, "no long, score long, id long"), ["no"], positives)
    near = near.groupBy("no").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("positives"))
    paired = settle(asking.join(near, "no"), "positives")
    kind = "no long, place int, score long, id long"
    found = _first(_search(paired, others, find_negatives, blocks, kind), ["no", "place"], negatives)
    named = paired.select("no", F.col("id").alias("anchor_id"), "positives")
    positive = F.get("positives", "place")
    return found.join(named, "no").select(
        "anchor_id",
        positive["id"].alias("positive_id"),
        "rank",
        F.col("id").alias("negative_id"),
        positive["score"].alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
