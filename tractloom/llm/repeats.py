"""Removing bytes covered by a 100-byte string that also starts earlier, with suffix sorting where it decides.

Texts are UTF-8 bytes. The 100-byte windows of a text fall into segments: consecutive windows whose smallest hash of
32-byte strings is the same. That value depends on a window's content alone, so equal windows share it, and it is
the key under which segments of all documents meet.

* Equal segments under one key: all but the first are removed as they stand, by hash of the content.
* Different segments under one key, and segments that may repeat themselves: their bytes are fetched. Stretches whose
  windows' hashes occur twice are put in a row and suffix-sorted; equal windows are then neighbours, and all but the earliest of each run are removed.

Suffixes are sorted without renaming or recursion. Groups start as suffixes with one first symbol and are processed
in descending order. When a group is reached, its suffixes share their longest Lyndon prefix; for each the nearest
position to the left in a smaller group, the previous smaller one, has its prefix extended and moves to a group right
after its own. Then suffixes are emitted in ascending order: each emitted one puts those whose Lyndon prefix ends
where it starts at the front of their groups.

Hot passages are reduced in every batch before they move, so a key sees a passage once per batch; runs are streamed.
Where more than `SORTED` bytes would have to be sorted together, windows are grouped by 128-bit hashes instead, and a
key with more different text than `SORT_BYTES` has its windows grouped that way in a shuffle.

Nulls and odd input: a null text is empty; a null id comes before all others; rows with one id, repeated rows
included, count in the order of the table; texts under 100 bytes stay whole; empty tables stay empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractloom.llm.common import col, settle, unpacked, whole

LENGTH = 100
GRAM = 32
PER_WINDOW = LENGTH - GRAM + 1
#: Bytes of segments looked at together, the most of what is left of them to be sorted, and the most of one key.
TOGETHER = 1 << 18
SORTED = 1 << 20
SORT_BYTES = 1 << 24
NULL_ID = -(1 << 63)

_BASE, _OTHER_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_powers: dict[int, np.ndarray] = {}

SEGMENT = "key long, seg long, id long, row long, start int, windows int, repeats boolean, decided boolean"
RANGE = "row long, start int, windows int"


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            have = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)])
        _powers[base] = have
    return have[:n]


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:  # noqa: ANN001
    """The smallest or largest of every `width` consecutive values, by doubling."""
    have = 1
    while have * 2 <= width:
        values = pick(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def _hashes(data: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """A hash of every `width` consecutive numbers, the same for equal ones wherever they stand."""
    n = len(data)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data.astype(np.uint64) * _power(base, n))])
    mixed = (total[width:] - total[:-width]) * _power(pow(base, -1, 1 << 64), n - width + 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed ^= mixed >> np.uint64(shift)
        mixed *= np.uint64(factor)
    mixed ^= mixed >> np.uint64(31)
    return mixed


def segments(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, numbers of windows, keys, and whether the key's string occurs more than once in the segment."""
    n = len(text)
    if n < LENGTH:
        none = np.empty(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(bool)
    grams = _hashes(np.frombuffer(text, np.uint8).astype(np.int16) + 1, GRAM)
    least = _sliding(grams, PER_WINDOW, np.minimum)
    starts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    counts = np.diff(np.r_[starts, len(least)])
    keys = least[starts]
    # Grams that are the smallest of some window; a segment whose key is met twice among them may repeat itself.
    edge = np.zeros(PER_WINDOW - 1, np.uint64)
    widest = _sliding(np.concatenate([edge, least, edge]), PER_WINDOW, np.maximum)
    smallest = np.flatnonzero(grams == widest)
    low = np.searchsorted(smallest, starts)
    high = np.searchsorted(smallest, starts + counts + PER_WINDOW - 1)
    met = np.zeros(len(starts), np.int64)
    step, open_ = 0, np.arange(len(starts))
    while len(open_):
        at = low[open_] + step
        met[open_] += grams[smallest[np.minimum(at, len(smallest) - 1)]] == keys[open_]
        step += 1
        open_ = open_[(low[open_] + step < high[open_]) & (met[open_] < 2)]
    return starts, counts, keys, met > 1


def _firsts(key: list[np.ndarray], order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers sorted by key and order, and whether each is the first of its key."""
    by = np.lexsort([*reversed(order), *reversed(key)])
    new = np.zeros(len(by), bool)
    new[:1] = True
    for k in key:
        new[1:] |= k[by[1:]] != k[by[:-1]]
    return by, new


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents (id, row, body) to segments; those with an equal one earlier in the batch are decided.

    Decided segments only pass through, so they take a key of their own and don't pile up under a common one.
    """
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        parts: list[list[np.ndarray]] = [[] for _ in range(7)]
        for doc, row, body in zip(batch["id"], batch["row"], batch["body"], strict=True):
            starts, counts, keys, repeats = segments(body)
            if not len(starts):
                continue
            view = memoryview(body)
            ends = (starts + counts + (LENGTH - 1)).tolist()
            hashes = [digest(view[s:e]) for s, e in zip(starts.tolist(), ends, strict=True)]
            size = len(starts)
            for part, values in zip(
                parts,
                (keys.view(np.int64), np.array(hashes, np.uint64).view(np.int64), np.full(size, doc),
                 np.full(size, row), starts, counts, repeats),
                strict=True,
            ):
                part.append(values)
        if parts[0]:
            key, seg, doc, row, start, windows, repeats = map(np.concatenate, parts)
            by, new = _firsts([key, seg], [doc, row, start])
            first = np.zeros(len(by), bool)
            first[by] = new
            yield pd.DataFrame(
                {
                    "key": np.where(first, key, row * 0x9E3779B1 + start), "seg": seg, "id": doc, "row": row,
                    "start": start.astype(np.int32), "windows": windows.astype(np.int32), "repeats": repeats,
                    "decided": ~first,
                }
            )


def _settle_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments sorted by key, seg and place: later ones of a run are removed, keys with several runs are asked.

    Holds one row between batches: the first of the current key, until it is known whether it has company.
    """
    last_key = last_seg = None
    pending: pd.DataFrame | None = None
    for whole_batch in batches:
        decided = whole_batch["decided"].to_numpy(bool)
        if decided.any():
            yield whole_batch[decided].assign(asked=False)
        batch = whole_batch[~decided]
        if not len(batch):
            continue
        key, seg = batch["key"].to_numpy(np.int64), batch["seg"].to_numpy(np.int64)
        key_first = np.r_[last_key is None or key[0] != last_key, key[1:] != key[:-1]]
        run_first = key_first | np.r_[last_seg is None or seg[0] != last_seg, seg[1:] != seg[:-1]]
        more = run_first & ~key_first
        asked = more | (run_first & batch["repeats"].to_numpy(bool))
        heads = np.flatnonzero(key_first)
        # A key's first run is asked as well when another follows; the head may be in an earlier batch.
        of = np.searchsorted(heads, np.flatnonzero(more), side="right") - 1
        asked[heads[np.unique(of[of >= 0])]] = True
        out = batch.assign(asked=asked)[asked | ~run_first]
        if pending is not None and (of < 0).any():
            yield pending.assign(asked=True)
            pending = None
        if len(out):
            yield out
        if len(heads):
            tail = heads[-1]
            pending = None if asked[tail] else batch.iloc[[tail]]
        last_key, last_seg = key[-1], seg[-1]


def suffix_order(text: np.ndarray) -> list[int]:
    """The order of all suffixes of a sequence of small numbers; a suffix precedes those that extend it."""
    n = len(text)
    symbols = text.tolist()
    # 1. Groups, as a list in ascending order, by first symbol.
    members: list[list[int]] = []
    after: list[int] = []
    before: list[int] = []
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(symbols):
        by_symbol.setdefault(c, []).append(i)
    group = [0] * n
    for g, c in enumerate(sorted(by_symbol)):
        members.append(by_symbol[c])
        for i in by_symbol[c]:
            group[i] = g
        before.append(g - 1)
        after.append(g + 1)
    if not members:
        return []
    after[-1] = -1
    prefix = [1] * n
    # lower[i + 1] leads to the nearest position at or left of i that is in no processed group; 0 is none.
    lower = list(range(n + 1))
    current = len(members) - 1
    while current >= 0:
        here = [i for i in members[current] if group[i] == current]
        members[current] = here
        if here:
            size = prefix[here[0]]
            for i in here:
                lower[i + 1] = i
            followed: dict[int, int] = {}
            for i in here:
                j = i
                while lower[j] != j:
                    lower[j] = lower[lower[j]]
                    j = lower[j]
                if j:
                    followed[j - 1] = followed.get(j - 1, 0) + 1
            moved: dict[tuple[int, int], list[int]] = {}
            for j, times in followed.items():
                moved.setdefault((times, group[j]), []).append(j)
            # More repetitions are greater: inserted first, they end up behind those with fewer.
            for times, old in sorted(moved, reverse=True):
                new = len(members)
                members.append(moved[times, old])
                for j in members[new]:
                    group[j] = new
                    prefix[j] += times * size
                follower = after[old]
                before.append(old)
                after.append(follower)
                after[old] = new
                if follower >= 0:
                    before[follower] = new
        current = before[current]
    # 2. Emit: who waits for whom, and where each group's front is.
    front = [0] * len(members)
    at, g = 1, 0
    while g >= 0:
        front[g] = at
        at += len(members[g])
        g = after[g]
    waiting = [-1] * (n + 1)
    chain = [-1] * n
    for j in range(n):
        end = j + prefix[j]
        chain[j] = waiting[end]
        waiting[end] = j
    order = [0] * (n + 1)
    order[0] = n
    for rank in range(n + 1):
        j = waiting[order[rank]]
        while j >= 0:
            g = group[j]
            order[front[g]] = j
            front[g] += 1
            j = chain[j]
    return order[1:]


class Row:
    """Pieces in a row of numbers, a zero after each; every window of every piece by owner and offset."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.lengths = np.array([len(p) for p in pieces])
        self.numbers = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int16) + 1
        self.ends = np.cumsum(self.lengths + 1) - 1
        self.numbers[self.ends] = 0
        self.begins = self.ends - self.lengths

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        counts = self.lengths - (LENGTH - 1)
        owner = np.repeat(np.arange(len(counts)), counts)
        return owner, np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)

    def by_piece(self, flags: np.ndarray) -> list[np.ndarray]:
        """Flags over the numbers, cut to each piece's windows."""
        return [flags[b : b + n - LENGTH + 1] for b, n in zip(self.begins, self.lengths, strict=True)]


def candidates(pieces: list[bytes]) -> list[tuple[int, int, int]]:
    """(piece, from, to): the stretches whose windows have the hash of another window; no equal windows are missed."""
    row = Row(pieces)
    owner, offset = row.windows()
    hashes = _hashes(row.numbers, LENGTH)[row.begins[owner] + offset]
    by = np.argsort(hashes, kind="stable")
    same = hashes[by[1:]] == hashes[by[:-1]]
    shared = np.zeros(len(hashes), bool)
    shared[by[1:][same]] = True
    shared[by[:-1][same]] = True
    where = np.flatnonzero(shared)
    if not len(where):
        return []
    breaks = np.flatnonzero((np.diff(where) > 1) | (np.diff(owner[where]) > 0)) + 1
    first, last = where[np.r_[0, breaks]], where[np.r_[breaks - 1, len(where) - 1]]
    return list(zip(owner[first].tolist(), offset[first].tolist(), (offset[last] + LENGTH).tolist(), strict=True))


def _later(run: np.ndarray, place: np.ndarray, own: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Of windows in runs of equal ones, those that are not at the earliest place; as positions in these arrays."""
    by = np.lexsort([place[own, 2] + offset, place[own, 1], place[own, 0], run])
    rest = np.ones(len(by), bool)
    rest[:1] = False
    rest[1:] = run[by[1:]] == run[by[:-1]]
    return by[rest]


def later_windows(pieces: list[bytes], place: np.ndarray) -> list[np.ndarray]:
    """For each piece, which of its windows also occur at an earlier place, by sorting all suffixes.

    place: rows of (id, row, start); the windows of a piece follow each other.
    """
    row = Row(pieces)
    owner = np.repeat(np.arange(len(pieces)), row.lengths + 1)
    left = row.ends[owner] - np.arange(len(row.numbers))
    order = np.array(suffix_order(row.numbers))
    order = order[left[order] >= LENGTH]
    windows = np.lib.stride_tricks.sliding_window_view(row.numbers, LENGTH)
    new = np.ones(len(order), bool)
    for at in range(1, len(order), 1 << 14):  # bounded memory
        end = min(len(order), at + (1 << 14))
        new[at:end] = (windows[order[at:end]] != windows[order[at - 1 : end - 1]]).any(axis=1)
    own = owner[order]
    later = np.zeros(len(row.numbers), bool)
    later[order[_later(np.cumsum(new), place, own, order - row.begins[own])]] = True
    return row.by_piece(later)


def later_hashes(pieces: list[bytes], place: np.ndarray) -> list[np.ndarray]:
    """The same by 128 bits of hashes, for more bytes than are sorted at once."""
    row = Row(pieces)
    owner, offset = row.windows()
    at = row.begins[owner] + offset
    one, two = (_hashes(row.numbers, LENGTH, base)[at] for base in (_BASE, _OTHER_BASE))
    by = np.lexsort([two, one])
    new = np.r_[True, (one[by[1:]] != one[by[:-1]]) | (two[by[1:]] != two[by[:-1]])]
    later = np.zeros(len(row.numbers), bool)
    later[at[by[_later(np.cumsum(new), place, owner[by], offset[by])]]] = True
    return row.by_piece(later)


def _ranges(later: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.r_[False, later, False].astype(np.int8)))
    return edges[::2], edges[1::2] - edges[::2]


def later_ranges(pieces: list[bytes], places: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(row, start, windows) of windows in pieces at (id, row, start) that occur at an earlier place among them."""
    out = []
    # Equal stretches: all but the first are later as a whole, and the first alone is compared with different ones.
    first: dict[bytes, tuple[int, int, int]] = {}
    for place, text in sorted(_stretches(pieces, places)):
        if first.setdefault(text, place) != place:
            out.append((place[1], place[2], len(text) - LENGTH + 1))
    left = sorted(_stretches(list(first), list(first.values())))
    if left:
        texts, where = [text for _, text in left], np.array([place for place, _ in left])
        judge = later_windows if sum(map(len, texts)) <= SORTED else later_hashes
        for (_, row, start), later in zip(where, judge(texts, where), strict=True):
            out += [(row, start + s, n) for s, n in zip(*_ranges(later), strict=True)]
    return out


def _stretches(pieces: list[bytes], places: list[tuple[int, int, int]]) -> list[tuple[tuple[int, int, int], bytes]]:
    return [
        ((places[k][0], places[k][1], places[k][2] + s), pieces[k][s:e]) for k, s, e in candidates(pieces)
    ] if pieces else []


def _sort_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Asked segments with their bytes, sorted by key: some keys' pieces are suffix-sorted together."""

    def judged(rows: pd.DataFrame) -> pd.DataFrame:
        places = list(zip(rows["id"].tolist(), rows["row"].tolist(), rows["start"].tolist(), strict=True))
        out = later_ranges(list(rows["piece"]), places)
        return pd.DataFrame(out, columns=["row", "start", "windows"])

    held: list[pd.DataFrame] = []
    for batch in batches:
        rows = pd.concat([*held, batch], ignore_index=True)
        held = []
        if not len(rows):
            continue
        key = rows["key"].to_numpy()
        size = np.cumsum(rows["piece"].str.len().to_numpy())
        bounds = np.flatnonzero(np.r_[key[1:] != key[:-1], False]) + 1
        at = 0
        while len(bounds):
            past = size[at - 1] if at else 0
            full = bounds[size[bounds - 1] - past >= TOGETHER]
            if not len(full):
                break
            yield judged(rows.iloc[at : full[0]])
            at = full[0]
            bounds = bounds[bounds > at]
        held = [rows.iloc[at:]]
    if held and len(held[0]):
        yield judged(held[0])


def _window_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Asked segments of very common keys to one row per window: (key, seg) is its 128-bit hash."""
    for batch in batches:
        rows = []
        for doc, row, start, piece in zip(batch["id"], batch["row"], batch["start"], batch["piece"], strict=True):
            for i in range(len(piece) - LENGTH + 1):
                digest = np.frombuffer(xxhash.xxh3_128_digest(piece[i : i + LENGTH]), "<i8")
                rows.append((digest[0], digest[1], doc, row, start + i, 1, False, False))
        yield pd.DataFrame(rows, columns=["key", "seg", "id", "row", "start", "windows", "repeats", "decided"])


def _fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, row, body, asked in zip(batch["id"], batch["row"], batch["body"], batch["asked"], strict=True):
            for a in asked:
                piece = body[a["start"] : a["start"] + a["windows"] + LENGTH - 1]
                rows.append((a["key"], doc, row, a["start"], piece, bool(a["common"])))
        yield pd.DataFrame(rows, columns=["key", "id", "row", "start", "piece", "common"])


def _runs(segments_: DataFrame) -> DataFrame:
    """Later equal segments (`asked` false) and segments that need a closer look (`asked` true)."""
    parts = int(segments_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = segments_.repartition(parts, "key").sortWithinPartitions("key", "seg", "id", "row", "start")
    return ordered.mapInPandas(_settle_runs, f"{SEGMENT}, asked boolean")


def removed_ranges(docs: DataFrame, sort_bytes: int = SORT_BYTES) -> DataFrame:
    """(row, start, windows): runs of windows that start earlier too; docs has id (no null), row and body."""
    runs = settle(_runs(docs.mapInPandas(_cut, SEGMENT)), "runs")
    found = [runs.filter("NOT asked")]

    asked = runs.filter("asked")
    sizes = asked.groupBy("key").agg(F.sum(F.col("windows") + F.lit(LENGTH - 1)).alias("bytes"))
    common = sizes.filter(F.col("bytes") > sort_bytes).select("key", F.lit(True).alias("common"))
    marked = asked.join(common, "key", "left")
    wanted = marked.groupBy("row").agg(
        F.collect_list(F.struct("key", "start", "windows", F.coalesce("common", F.lit(False)).alias("common"))).alias("asked")
    )
    pieces = settle(
        docs.join(wanted, "row").mapInPandas(
            _fetch, "key long, id long, row long, start int, piece binary, common boolean"
        ),
        "pieces",
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = pieces.filter("NOT common").repartition(parts, "key").sortWithinPartitions("key", "id", "row", "start")
    found.append(few.mapInPandas(_sort_pieces, RANGE))
    many = pieces.filter("common").mapInPandas(_window_hashes, SEGMENT)
    found.append(_runs(many).filter("NOT asked"))
    ranges = [f.select("row", "start", "windows") for f in found]
    return settle(ranges[0].union(ranges[1]).union(ranges[2]), "ranges")


RESULT = (
    "struct<n_bytes:long,n_removed:long,spans:array<struct<start:int,end:int>>,kept:binary,kept_sha256:string>"
)


def _remover(with_bytes: bool):  # noqa: ANN202
    """A UDF from text and removed ranges to what is left of the text."""

    def remove(bodies: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        rows = []
        for body, found in zip(bodies, ranges, strict=True):
            spans: list[list[int]] = []
            for start, windows in sorted((r["start"], r["windows"]) for r in (found if found is not None else ())):
                end = start + windows + LENGTH - 1
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], end)
                else:
                    spans.append([start, end])
            kept, at = [], 0
            for s, e in spans:
                kept.append(body[at:s])
                at = e
            left = b"".join([*kept, body[at:]]) if spans else body
            shown = [{"start": s, "end": e} for s, e in spans]
            rows.append(
                (len(body), len(body) - len(left), shown, left if with_bytes else None, hashlib.sha256(left).hexdigest())
            )
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "spans", "kept", "kept_sha256"])

    return F.pandas_udf(remove, RESULT)


def without_repeats(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    carried: list[str] | None = None,
    with_bytes: bool = True,
    sort_bytes: int = SORT_BYTES,
) -> DataFrame:
    """The carried columns (all, unless named), n_bytes, n_removed, spans (bytes), kept (bytes) and kept_sha256.

    Without `with_bytes`, `kept` is null and only its hash is given.
    """
    names = docs.columns if carried is None else carried
    plain = docs.select(
        whole(docs.select(*map(col, names))).alias("d") if names else F.struct(F.lit(0).alias("none")).alias("d"),
        F.coalesce(col(doc_id).cast("long"), F.lit(NULL_ID)).alias("id"),
        F.coalesce(col(text), F.lit("")).cast("binary").alias("body"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = settle(plain, "texts")
    ranges = removed_ranges(rows.select("id", "row", "body"), sort_bytes)
    by_row = ranges.groupBy("row").agg(F.collect_list(F.struct("start", "windows")).alias("ranges"))
    joined = rows.join(by_row, "row", "left").select("d", _remover(with_bytes)("body", "ranges").alias("r"))
    added = ["n_bytes", "n_removed", "spans", "kept", "kept_sha256"]
    return unpacked(joined.select("d", "r.*"), "d", names, added)
