"""Corpus operators do their whole job: nothing is left out because an input is large, long or far apart."""

import random

import pytest
from pyspark.sql import functions as F

from tractloom.llm import chat, language_model, simhash

# --- 2 -----------------------------------------------------------------------------------------------------------


def test_the_thousandth_word_is_read_as_itself():
    known = language_model.Vocabulary(b" ".join(b"w%d" % i for i in range(5000)))
    words = [b"w0", b"w381", b"w382", b"w999", b"w1021", b"w1022", b"new"]
    types = language_model.Vocabulary.types(known.places(words)).tolist()
    assert types == [2, 383, 384, 1001, 1023, language_model.UNKNOWN, language_model.UNKNOWN, language_model.END]
    assert sum(language_model.ROUNDS) == 8 and len(language_model.ROUNDS) == 3


# --- 8 -----------------------------------------------------------------------------------------------------------


def test_a_long_chain_in_random_order_is_one_component(spark):
    rng = random.Random(7)
    for nodes in (list(range(-600, 600)), [rng.getrandbits(63) - (1 << 62) for _ in range(1200)]):
        if nodes[0] == -600:
            nodes = nodes[::2] + nodes[1::2][::-1]
        chain = list(zip(nodes, nodes[1:], strict=False))
        other = [(1 << 62, (1 << 62) + 1)]
        links = spark.createDataFrame([(min(p), max(p)) for p in chain + other], "a long, b long").repartition(3)
        found = dict(simhash.components(links).collect())
        assert found == dict.fromkeys(nodes, min(nodes)) | dict.fromkeys(other[0], 1 << 62)


def test_successive_edits_of_fingerprints_are_one_component(spark):
    rng = random.Random(3)
    fp, fps = rng.getrandbits(64), []
    for _ in range(1500):
        fps.append(fp)
        for bit in rng.sample(range(64), 4):
            fp ^= 1 << bit
    nodes = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    unique = spark.createDataFrame([(n,) for n in nodes], "fp long")
    found = dict(simhash.components(simhash.fingerprint_links(unique)).collect())
    assert found == dict.fromkeys(nodes, nodes[0])


# --- 5 -----------------------------------------------------------------------------------------------------------


def test_parts_of_every_participant_make_the_whole_dialogue(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "cy", "only once")]
    turns += [(1, i, "ann" if i % 2 else "bob", f"t{i}") for i in range(2, 200)]
    turns += [(2, 1, "ann", f"{i:03}") for i in range(150)] + [(2, 2, "bob", "after the ties"), (2, None, "dee", "last")]
    # Numbers far apart make no part shorter.
    turns += [(5, 1000 * i, f"p{i % 20}", f"t{i}") for i in range(40)]
    turns += [(3, 1, "ann", "same")] * 70 + [(3, 0, None, "x"), (3, None, "bob", "y")] + [(4, 0, "system", "alone")]
    turns += [(None, 1, "ann", "x"), (None, 1, "bob", "x"), (None, 1, "system", "x")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    clashing = [F.lit(i).alias(name) for i, name in enumerate(["part", "range", "late", "copies", "conv", "spread"])]
    rows = chat.perspectives(frame.select("*", *clashing)).collect()
    assert sum(r.conv_id == 5 for r in rows) == 20
    got = {}
    for r in sorted(rows, key=lambda r: r.part):
        rendered, own = got.get((r.conv_id, r.speaker), ("", []))
        got[r.conv_id, r.speaker] = rendered + r.rendered, own + [r.rendered[m.start : m.end] for m in r.mask]
        assert r.n_turns <= chat.PART and r.n_own == len(r.mask)
    said = [(c, t, r or "unknown", x) for c, t, r, x in turns]
    wanted = {(None, "ann"): ("<|start|>assistant\nx<|end|>\n", ["x"]), (None, "bob"): ("<|start|>assistant\nx<|end|>\n", ["x"])}
    for conv, who in {(c, r) for c, _, r, _ in said if c is not None and r != "system"}:
        own = sorted((t[1:] for t in said if t[0] == conv), key=lambda t: (t[0] is None, t[0] or 0, *t[1:]))
        name = lambda r: "system" if r == "system" else "assistant" if r == who else f"user name={r}"  # noqa: B023, E731
        wanted[conv, who] = (
            "".join(f"<|start|>{name(r)}\n{x}<|end|>\n" for _, r, x in own),
            [x for _, r, x in own if r == who],
        )
    assert got == wanted


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_dialogue_in_many_ranges_and_blocks(spark, uncoalesced):
    n = 3 * chat.PART * chat.BLOCK + 5
    turns = spark.range(0, n, 1, 8).select(
        F.lit(7).alias("conv_id"), (F.col("id") * 3).alias("turn"),
        F.when(F.col("id") % 2 == 0, "ann").otherwise("bob").alias("role"), F.format_string("%05d", "id").alias("text"),
    )
    assert chat.ranged_turns(turns, "conv_id", "turn", "role", "text").select("range").distinct().count() > 1
    rows = chat.perspectives(turns).filter("speaker = 'bob'").orderBy("part").collect()
    assert [r.part for r in rows] == list(range(len(rows))) and {r.n_turns for r in rows[:-1]} == {chat.PART}
    own = [r.rendered[m.start : m.end] for r in rows for m in r.mask]
    assert own == [f"{i:05}" for i in range(1, n, 2)]
