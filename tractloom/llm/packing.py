"""Sequences of tokens for training, packed along a space-filling curve.

Every document becomes token ids, and its ids a vector: counts of hashed ids. Random signs project that vector to a few
dimensions, divided by the document's length. Centred and scaled by the corpus, the coordinates are the corners of a
fine grid, and a document's place on the grid's Hilbert curve is its key: documents near each other on the curve use
similar words. Documents are sorted by key in ranges; each range fills sequences to the last token, cutting documents
where a sequence ends, so that neighbours on the curve share sequences. What is left at the end of a range is cut into
lengths that are powers of two, which take no padding.

White space always separates tokens, so the text between two white spaces is what the tokenizer gets. Texts are read
together, some megabytes at a time, and each of their words is looked up once; a very long one is read in slices, so that
it takes no more memory than its ids. What the tokenizer made of words is remembered, in two generations of bounded size;
of plain words, which differ in signs behind them and in large letters, letters and signs are remembered apart.

Nulls and odd input: null and empty texts consist of the end id alone. Copies have one key and are told apart by id and
row, so that no number of them makes a range uneven; null ids come first. Repeated rows are packed once each. An empty
table gives no pieces. Columns added here replace input columns of the same name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, normalizers

from tractloom.llm.common import col, settle, unpacked, whole

LENGTH = 2048
END = 1
#: Bins of hashed ids, dimensions they are projected to, and bits of a coordinate.
BINS = 4096
DIMENSIONS = 4
BITS = 15
#: Coordinates are whole numbers, so that their sums over the corpus don't depend on the order: units of one sign.
UNIT = 1 << 20
#: The grid covers so many standard deviations on either side of the mean.
SPREAD = 4.0
SEED = 5
#: Words of one generation of the memory, the longest that is kept, bytes of one text that are split at once, bytes of
#: several texts whose words are looked up together, and words that the tokenizer gets at once.
REMEMBERED = 250_000
LONGEST = 64
SLICE = 1 << 20
TOGETHER = 1 << 23
AT_ONCE = 2000

ADDED = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
_SPACE = re.compile(rb"[ \t-\r]")
#: Stands between words that are looked up together; it is matched before a text is split into words.
_BETWEEN = "<|startoftext|>"
#: A word between blanks. Plain ones are letters that have one lower case and one spelling, and signs behind them that
#: begin no ending: one or two parts, each of which the tokenizer closes with an id of a token that ends a word.
_PARTS = re.compile("(?:([A-Za-zÀ-ÖØ-öø-įı-ɏ]++)([!-&(-/:-@[-`{-~]++)?|([^ ]+))(?= |\\Z)")
#: Fixed value: how a tokenizer's file states a normalisation that only lowers the letters of such words.
_LOWERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
#: Fixed value: how it states that letters and signs are parts of their own.
_SPLITS = {
    "type": "Split",
    "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}


# --- ids ---------------------------------------------------------------------------------------------------------


class _NotClosed(Exception):
    """The vocabulary does not close the parts of plain words one by one."""


class Words:
    """Ids of words as bytes of little-endian 32-bit numbers, remembered."""

    def __init__(self, path: str, between: str = _BETWEEN) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.between, self.mark = between, self.tokenizer.token_to_id(between)
        closing = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: For the parts of plain words, which are lowered before; None where the file states other rules.
        self.plain = Tokenizer.from_file(path)
        stated = json.loads(self.plain.to_str())
        lowers = stated["normalizer"] == {"type": "Sequence", "normalizers": _LOWERS}
        splits = _SPLITS in ((stated["pre_tokenizer"] or {}).get("pretokenizers") or [])[:1]
        if lowers and splits and closing:
            self.plain.normalizer = normalizers.Sequence([])
        else:
            self.plain = None
        #: Which ids close a word, where the vocabulary says so.
        self.closes = np.zeros(self.tokenizer.get_vocab_size() if closing else 0, bool)
        if closing:
            self.closes[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(closing)]] = True
        #: Ids of parts, which are text, and of other words, which are bytes.
        self.young: dict[str | bytes, bytes] = {}
        self.old: dict[str | bytes, bytes] = {}

    def _encoded(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Words and their ids, in order."""
        if words:
            yield from zip(words, self._plain_ids(words) or self._known(words, self._marked), strict=True)

    def _plain_ids(self, words: list[bytes]) -> list[bytes] | None:
        """Ids of words from those of their parts; nothing if the vocabulary does not close each part."""
        if self.plain is None:
            return None
        # No word holds a blank, and a broken character at a word's end does not take the blank along.
        found = _PARTS.findall(b" ".join(words).decode("utf-8", "replace"))
        letters = " ".join([m[0] for m in found]).lower().split(" ")
        signs = {m[1] for m in found}
        keys = [x or w for w, x in zip(words, letters, strict=True)]
        try:
            ends = dict(zip(signs, self._known([*signs], self._closed), strict=True))
            ids = self._known(keys, self._closed)
        except _NotClosed:
            return None
        return [x + ends[m[1]] if m[1] else x for x, m in zip(ids, found, strict=True)]

    def _known(self, keys: list, encode) -> list[bytes]:  # noqa: ANN001
        """Ids of parts or words, from the memory or else from `encode`."""
        young = self.young
        known = list(map(young.get, keys))
        gaps = [i for i, ids in enumerate(known) if ids is None]
        if gaps:
            new, here = [], {}
            for key in {keys[i] for i in gaps}:
                if (ids := self.old.get(key)) is not None:
                    young[key] = here[key] = ids
                else:
                    new.append(key)
            for at in range(0, len(new), AT_ONCE):
                some = new[at : at + AT_ONCE]
                here.update(zip(some, encode(some), strict=True))
            young.update((key, here[key]) for key in new if len(key) <= LONGEST)
            for i in gaps:
                known[i] = here[keys[i]]
        return known

    def _closed(self, keys: list[str | bytes]) -> list[bytes]:
        """Ids of parts, told apart by the ids that close them, and of other words."""
        parts = [key for key in keys if key and isinstance(key, str)]
        found = {"": b""}
        if parts:
            ids = np.array(self.plain.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
            if len(ends) != len(parts):
                raise _NotClosed
            data = ids.tobytes()
            found.update((part, data[s:e]) for part, s, e in zip(parts, [0, *ends], ends, strict=False))
        other = [key for key in keys if isinstance(key, bytes)]
        found.update(zip(other, self._marked(other), strict=True) if other else ())
        return [found[key] for key in keys]

    def _marked(self, words: list[bytes]) -> Iterator[bytes]:
        texts = [w.decode("utf-8", "replace") for w in words]
        if self.mark is None or any(self.between in t for t in texts):
            for t in texts:
                yield np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            return
        ids = np.array(
            self.tokenizer.encode_batch_fast([self.between.join(texts)], add_special_tokens=False)[0].ids, "<u4"
        )
        cuts = np.flatnonzero(ids == self.mark)
        data = ids.tobytes()
        starts, ends = [0, *((cuts + 1) * 4).tolist()], [*(cuts * 4).tolist(), len(data)]
        yield from (data[s:e] for s, e in zip(starts, ends, strict=True))

    def ids(self, text: bytes) -> bytes:
        """Ids of a whole text."""
        return next(self.each([text])).tobytes()

    def each(self, texts: Iterable[bytes]) -> Iterator[np.ndarray]:
        """Ids of whole texts, in order."""
        slices, last, size = [], [], 0
        #: What was found of a text that is not complete.
        begun: list[np.ndarray] = []
        for text in texts:
            at = 0
            while at < len(text) or at == 0:
                space = _SPACE.search(text, at + SLICE)
                end = space.end() if space else max(len(text), 1)
                slices.append(text[at:end])
                last.append(end >= len(text))
                size += end - at
                at = end
                if size >= TOGETHER:
                    yield from self._joined(slices, last, begun)
                    slices, last, size = [], [], 0
        yield from self._joined(slices, last, begun)

    def _joined(self, slices: list[bytes], last: list[bool], begun: list[np.ndarray]) -> Iterator[np.ndarray]:
        for ids, ends in zip(self._together(slices), last, strict=True):
            begun.append(ids)
            if ends:
                yield np.concatenate(begun) if len(begun) > 1 else ids
                begun.clear()

    def _together(self, slices: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of slices whose words are looked up once."""
        # What this pool frees goes back to the machine at once.
        pool = pa.system_memory_pool()
        binary = pa.array(slices, pa.binary(), memory_pool=pool)
        split = pc.ascii_split_whitespace(binary.view(pa.string()), memory_pool=pool)
        coded = pc.dictionary_encode(split.flatten(), memory_pool=pool)
        bounds, codes = split.offsets.to_numpy().tolist(), coded.indices.to_numpy()
        words = coded.dictionary.view(pa.binary())
        del binary, split, coded
        data, sizes = [], []
        for at in range(0, len(words), 10 * AT_ONCE):
            some = words[at : at + 10 * AT_ONCE].to_pylist()
            found = [ids for _, ids in self._encoded([w for w in some if w])]
            # White space at a slice's begin or end leaves an empty word.
            if b"" in some:
                found.insert(some.index(b""), b"")
            data.append(b"".join(found))
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)) // 4)
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        data, sizes = np.frombuffer(b"".join(data), "<u4"), np.concatenate([np.empty(0, np.int64), *sizes])
        begins = np.cumsum(sizes) - sizes
        for start, end in zip(bounds, bounds[1:], strict=False):
            own = codes[start:end]
            long = sizes[own]
            ends = np.cumsum(long)
            places = np.repeat(begins[own] - ends + long, long)
            places += np.arange(len(places))
            yield data[places]


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    """One memory per Python worker and vocabulary."""
    return Words(path)


@lru_cache(maxsize=2)
def _signs(types: int) -> np.ndarray:
    """For each id the signs that its bin adds to the coordinates: 16 bits a coordinate, of value 1 for a plus."""
    random = np.random.default_rng(SEED)
    bins = random.choice(np.array([-1, 1], np.int32), (BINS, DIMENSIONS))
    hashed = (np.arange(types, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    plus = ((bins > 0).astype(np.int64) << (16 * np.arange(DIMENSIONS))).sum(axis=1)
    return plus[(hashed >> np.uint64(40)) % np.uint64(BINS)]


def _sums(signs: np.ndarray, ids: np.ndarray) -> list[int]:
    """Sums of the ids' signs by coordinate."""
    plus, most = [0] * DIMENSIONS, (1 << 16) - 1
    for at in range(0, len(ids), most):
        total = int(signs[ids[at : at + most]].sum())
        plus = [p + (total >> 16 * i & most) for i, p in enumerate(plus)]
    return [2 * p - len(ids) for p in plus]


# --- the curve ---------------------------------------------------------------------------------------------------


def hilbert_keys(corners: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of grid corners (rows of coordinates below 2 ** bits), as int64.

    Coordinates are turned into the curve's transposed index bit by bit from the top: a set bit mirrors the lower bits
    of the first axis, a clear one swaps them with the first axis; then the Gray code is undone and bits interleaved.
    """
    x = np.array(corners, np.int64).T.copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        top, low = 1 << bit, (1 << bit) - 1
        for axis in range(n):
            mirrored = (x[axis] & top) != 0
            swap = np.where(mirrored, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(mirrored, low, swap)
            x[axis] ^= swap
    for axis in range(1, n):
        x[axis] ^= x[axis - 1]
    flips = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flips ^= np.where((x[n - 1] & (1 << bit)) != 0, (1 << bit) - 1, 0)
    x ^= flips
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in range(n):
            key = (key << 1) | ((x[axis] >> bit) & 1)
    return key


# --- documents ---------------------------------------------------------------------------------------------------

_COORDINATES = [f"x{i}" for i in range(DIMENSIONS)]
_TOKENISED = T.StructType(
    [T.StructField("ids", T.BinaryType()), T.StructField("n", T.LongType())]
    + [T.StructField(x, T.LongType()) for x in _COORDINATES]
)


def _tokenise(path: str, end: int):  # noqa: ANN202
    """Ids with the end id, their number, and mean signs in UNITs."""

    def tokenise(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = _words(path)
        signs = _signs(max(words.tokenizer.get_vocab_size(), end + 1))
        last = np.array([end], "<u4")
        # Ids below 65,536 are stored as 16-bit numbers.
        kind = "<u2" if len(signs) <= 1 << 16 else "<u4"
        for batch in batches:
            ids, sizes, places = [], [], []
            for found in words.each(batch):
                own = np.append(found, last)
                ids.append(own.astype(kind).tobytes())
                sizes.append(len(own))
                places.append([b * UNIT // len(own) for b in _sums(signs, own)])
            out = pd.DataFrame(np.array(places, np.int64).reshape(-1, DIMENSIONS), columns=_COORDINATES)
            out.insert(0, "n", np.array(sizes, np.int64))
            out.insert(0, "ids", pd.Series(ids, dtype=object))
            yield out

    return F.pandas_udf(tokenise, _TOKENISED)


def _keyed(tokenised: DataFrame) -> DataFrame:
    """With `key`, the place on the curve of the corpus's grid."""
    moments = [F.count(F.lit(1)).alias("n")]
    for x in _COORDINATES:
        exact = F.col(x).cast("decimal(19,0)")
        moments += [F.sum(exact).alias(x), F.sum(exact * exact).alias(f"{x}_squared")]
    got = tokenised.agg(*moments).first()
    n = got["n"] or 1
    mean = np.array([float(got[x] or 0) / n for x in _COORDINATES])
    square = np.array([float(got[f"{x}_squared"] or 0) / n for x in _COORDINATES])
    width = np.maximum(np.sqrt(np.maximum(square - mean * mean, 0)), 1.0)
    half = 1 << (BITS - 1)

    @F.pandas_udf("long")
    def key(*columns: pd.Series) -> pd.Series:
        coordinates = np.column_stack([c.to_numpy(np.float64) for c in columns])
        scaled = np.floor((coordinates - mean) / (width * SPREAD) * half) + half
        return pd.Series(hilbert_keys(np.clip(scaled, 0, 2 * half - 1).astype(np.int64), BITS))

    return tokenised.withColumn("key", key(*_COORDINATES))


def _powers(n: int) -> list[int]:
    """Powers of two that add up to n, the largest first."""
    return [1 << bit for bit in range(n.bit_length() - 1, -1, -1) if n >> bit & 1]


def _pack(length: int, wide: bool, schema: pa.Schema | None = None):  # noqa: ANN202
    """Pieces of the documents of one range, in order: sequences are filled one after the other."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        #: Pieces of the sequence that is not full yet, each with its row as a table of one row.
        open_, filled, sequence = [], 0, 0
        kept: list[pa.Array] = []

        def batch_of(pieces: list, rows: pa.Array) -> pa.RecordBatch:
            columns = list(zip(*pieces, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True)]
            return pa.RecordBatch.from_arrays([rows.take(pa.array(columns[0], pa.int64())), *arrays], ["d", *ADDED])

        for batch in batches:
            rows = batch.column("d")
            if kept:
                rows = pa.concat_arrays([*kept, rows])
            before = len(rows) - batch.num_rows
            done: list[tuple] = []
            size = 0
            for i, raw in enumerate(batch.column("ids")):
                ids = np.frombuffer(raw.as_buffer(), "<u4" if wide else "<u2").astype("<u4")
                at, total = 0, len(ids)
                while at < total:
                    take = min(total - at, length - filled)
                    open_.append((before + i, at, take, ids[at : at + take].tobytes(), total, first + sequence, filled))
                    at, filled = at + take, filled + take
                    if filled == length:
                        done += open_
                        open_, filled, sequence = [], 0, sequence + 1
                        size += 4 * length
                        if size > 1 << 23:
                            yield batch_of(done, rows)
                            done, size = [], 0
            if done:
                yield batch_of(done, rows)
            # Rows of the open sequence are carried along.
            kept = [rows.take(pa.array([p[0] for p in open_], pa.int64()))] if open_ else []
            open_ = [(j, *p[1:]) for j, p in enumerate(open_)]
        if open_:
            done, powers = [], iter(_powers(filled))
            room, offset = next(powers), 0
            for row, start, size, ids, total, _, _ in open_:
                at = 0
                while at < size:
                    take = min(size - at, room - offset)
                    done.append((row, start + at, take, ids[4 * at : 4 * (at + take)], total, first + sequence, offset))
                    at, offset = at + take, offset + take
                    if offset == room:
                        sequence, offset, room = sequence + 1, 0, next(powers, 0)
            yield batch_of(done, pa.concat_arrays(kept))

    return pack


def packed_pieces(
    docs: DataFrame,
    vocabulary: str,
    text: str = "text",
    doc_id: str = "doc_id",
    carried: list[str] | None = None,
    length: int = LENGTH,
    end: int = END,
) -> DataFrame:
    """The carried columns (all, unless named) and, per piece: start, length, ids, doc_tokens, sequence_id, offset.

    `vocabulary` is the path of the tokenizer's file on every executor; `end` is put behind each document. `ids` are
    little-endian 32-bit numbers. `length` must be a power of two.
    """
    names = docs.columns if carried is None else carried
    body = F.coalesce(col(text).cast("string"), F.lit("")).cast("binary")
    taken = docs.select(
        (whole(docs.select(*map(col, names))) if names else F.struct(F.lit(0).alias("none"))).alias("d"),
        col(doc_id).alias("id"),
        F.monotonically_increasing_id().alias("row"),
        _tokenise(vocabulary, end)(body).alias("t"),
    )
    tokenised = settle(taken.select("d", "id", "row", "t.*"), "tokens")
    keyed = _keyed(tokenised).select("d", "id", "row", "ids", "key")
    ranged = keyed.repartitionByRange("key", "id", "row").sortWithinPartitions("key", "id", "row").select("d", "ids")
    wide = max(Tokenizer.from_file(vocabulary).get_vocab_size(), end + 1) > 1 << 16
    kind = T.StructType(
        [ranged.schema["d"]]
        + [
            T.StructField(a, T.BinaryType() if a == "ids" else T.LongType())
            for a in ADDED
        ]
    )
    return unpacked(ranged.mapInArrow(_pack(length, wide), kind), "d", names, ADDED)
