"""Packing along the curve: nothing is lost, nothing is padded, neighbours are alike."""

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tractloom.llm import packing
from tractloom.llm.registry import QUERIES

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LONG = "one very long text, " * 60_000
ODD = [
    (None, None), (None, "no id"), (1, ""), (2, " \t\x0b\f\r\n"), (3, LONG), (4, "copies of one text"),
    (4, "copies of one text"), (5, "copies of one text"), (6, "<|endoftext|> inside<|startoftext|>here <|startoftext|>"),
    (7, "Ünïcode \U0001f600 ẞ İ K é ́ don't I'LL '' a\x1cb\x85c d e"), (8, "q" * 50_000),
    (9, "x " * 3000 + "w" * 100),
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def checked(rows, texts, tokenizer, length=2048):
    """Pieces (place in texts, start, length, ids, doc_tokens, sequence_id, offset) are whole and gapless."""
    by_doc, by_sequence = {}, {}
    for row in rows:
        by_doc.setdefault(row[0], []).append(row[1:])
        by_sequence.setdefault(row[5], []).append((row[6], row[2]))
    assert set(by_doc) == set(range(len(texts)))
    for key, pieces in by_doc.items():
        whole = [*tokenizer.encode(texts[key] or "", add_special_tokens=False).ids, 1]
        pieces.sort()
        ends = [0, *np.cumsum([p[1] for p in pieces]).tolist()]
        assert [p[0] for p in pieces] == ends[:-1] and ends[-1] == len(whole)
        assert all(p[1] > 0 and p[3] == len(whole) for p in pieces)
        assert np.frombuffer(b"".join(p[2] for p in pieces), "<u4").tolist() == whole
    short = 0
    for pieces in by_sequence.values():
        pieces.sort()
        ends = [0, *np.cumsum([p[1] for p in pieces]).tolist()]
        assert [p[0] for p in pieces] == ends[:-1] and ends[-1] <= length
        assert ends[-1].bit_count() == 1  # full, or of a length that takes no padding
        short += ends[-1] < length
    return short


def numbered(spark, texts):
    rows = [(i, *t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "at int, doc_id long, text string")


COLUMNS = ["at", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def test_odd_texts_come_back_whole(spark, tokenizer):
    docs = numbered(spark, ODD)
    for name in ("d", "id", "row", "key", "n", "x0", "ids", "t", "offset"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    pieces = packing.packed_pieces(docs.repartition(3), VOCABULARY)
    assert [r[0] for r in pieces.select("row").distinct().collect()] == ["own row"]
    checked([tuple(r) for r in pieces.select(COLUMNS).collect()], [t for _, t in ODD], tokenizer)


def test_short_sequences_and_another_end(spark, tokenizer):
    docs = numbered(spark, [(i, "some words " * (i % 50)) for i in range(300)])
    pieces = packing.packed_pieces(docs, VOCABULARY, length=64, end=49407, carried=["at"]).collect()
    assert {len(r["ids"]) // 4 for r in pieces if r["start"] + r["length"] < r["doc_tokens"]} <= set(range(1, 65))
    assert all(np.frombuffer(r["ids"], "<u4")[-1] == 49407 for r in pieces if r["start"] + r["length"] == r["doc_tokens"])
    assert {len(r["ids"]) for r in pieces} <= {4 * n for n in range(1, 65)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.packed_pieces(docs, VOCABULARY).count() == 0


def test_query_on_the_test_table(spark, folder, tokenizer):
    found = QUERIES["op12_curve_packing"](spark, folder).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    places = {d: i for i, d in enumerate(texts)}
    whole = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in texts.items()}
    rows = []
    for r in found:
        ids = whole[r.doc_id][r.start : r.start + r.length].tobytes()
        assert r.ids_crc32 == zlib.crc32(ids)
        rows.append((places[r.doc_id], r.start, r.length, ids, r.doc_tokens, r.sequence_id, r.offset))
    short = checked(rows, list(texts.values()), tokenizer)
    tasks = {r.sequence_id >> 40 for r in found}
    assert short <= 11 * len(tasks)


def test_words_are_remembered_within_bounds(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    monkeypatch.setattr(packing, "SLICE", 400)
    words = packing.Words(VOCABULARY)
    rng = random.Random(2)
    for _ in range(40):
        text = " ".join(f"w{rng.randrange(200)}" + "y" * rng.choice([0, 0, 90]) for _ in range(300))
        wanted = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.ids(text.encode()), "<u4").tolist() == wanted
        assert len(words.young) <= 400 and len(words.old) <= 400
        assert all(len(w) <= packing.LONGEST for w in words.young)


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 3), (3, 2), (4, 2), (1, 4)])
def test_the_curve_visits_every_corner_in_steps_of_one(dimensions, bits):
    grid = np.stack(np.meshgrid(*[range(1 << bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
    keys = packing.hilbert_keys(grid, bits)
    assert sorted(keys) == list(range(len(grid)))
    steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1)
    assert set(steps) == {1}


def test_neighbours_on_the_curve_use_the_same_words(spark):
    rng = random.Random(4)
    tongues = [[f"{a}{b}{c}" for a in start for b in "aeiou" for c in "lnrst"] for start in ("bd", "fg", "kp", "vz")]
    rows = [(i, " ".join(rng.choices(tongues[i % 4], k=200))) for i in range(400)]
    pieces = packing.packed_pieces(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY)
    held = {}
    for r in pieces.select("doc_id", "sequence_id").collect():
        held.setdefault(r.sequence_id, set()).add(r.doc_id % 4)
    # In random order hardly any sequence would hold a single tongue: about one of fifty.
    assert np.mean([len(h) == 1 for h in held.values()]) > 0.5


def test_words_looked_up_together_equal_each_on_its_own(tokenizer):
    letters = [chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x250)]]
    signs = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    words = [f"{x}b" for x in letters] + [f"b{x}" for x in letters] + [f"Ab{s}" for s in signs] + [f"{s}b{s}{s}" for s in signs]
    words += ["it's", "ab'll", "ab''", "éa", "́b", "ȧ", "ab ", "　ab", "12ab", "ab12", "ab\x00", "ab!é"]
    memory = packing.Words(VOCABULARY)
    encoded = dict(memory._encoded([w.encode() for w in words] + [b"ab\xff", b"\xc3", b"ab\xc3"]))
    for word, ids in encoded.items():
        alone = tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == alone, word
    assert set(encoded) == {*(w.encode() for w in words), b"ab\xff", b"\xc3", b"ab\xc3"}


class Recorder:
    """Passes words on to a tokenizer and remembers them."""

    def __init__(self, tokenizer):
        self.tokenizer, self.got = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.got += " ".join(texts).split(" ")
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_letters_and_signs_of_plain_words_are_looked_up_once(tokenizer):
    memory = packing.Words(VOCABULARY)
    memory.plain = Recorder(memory.plain)
    texts = ["many words, MANY words.", "Many, Words; manY.", "words many words,,"]
    for text in texts:
        wanted = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(memory.ids(text.encode()), "<u4").tolist() == wanted
    assert sorted(memory.plain.got) == sorted(["many", "words", ",", ".", ";", ",,"])


@pytest.mark.parametrize("together", [1, 50, 10_000])
def test_texts_read_together_equal_each_on_its_own(tokenizer, monkeypatch, together):
    monkeypatch.setattr(packing, "TOGETHER", together)
    monkeypatch.setattr(packing, "SLICE", 20)
    texts = [t.encode() for _, t in ODD if t and len(t) < 50_000] + [b"", b"  ", b" ab\xff \xc3", b"\x0bx\x0c", b"Ab,\n\nab."]
    found = list(packing.Words(VOCABULARY).each(texts))
    assert len(found) == len(texts)
    for text, ids in zip(texts, found, strict=True):
        assert ids.tolist() == tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, text


def test_a_vocabulary_of_other_rules_gets_whole_words(tokenizer, tmp_path):
    stated = json.loads(tokenizer.to_str())
    stated["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
    (tmp_path / "other.json").write_text(json.dumps(stated))
    other = Tokenizer.from_file(str(tmp_path / "other.json"))
    text = "One word, WORD. and word, ab12 don't"
    assert other.encode(text).ids != tokenizer.encode(text).ids
    found = packing.Words(str(tmp_path / "other.json")).ids(text.encode())
    assert np.frombuffer(found, "<u4").tolist() == other.encode(text, add_special_tokens=False).ids


def test_sums_of_signs_hold_for_many_ids(tokenizer):
    signs = packing._signs(tokenizer.get_vocab_size())
    ids = np.random.default_rng(1).integers(0, len(signs), 200_000)
    each = (signs[:, None] >> (16 * np.arange(packing.DIMENSIONS)) & 1) * 2 - 1
    assert packing._sums(signs, ids) == each[ids].sum(axis=0).tolist()
    same = np.full(200_000, ids[0])
    assert packing._sums(signs, same) == (each[ids[0]] * 200_000).tolist()
