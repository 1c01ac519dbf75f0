"""Repair of dialogues against exhaustive search, in one chunk and in many."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tractloom.llm import structure as st

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = re.compile("[\x20\x09-\x0d]*\\Z")
GRAMMAR = re.compile("(s?(ua)+)?\\Z")
BEGINNING = re.compile("s?(ua)*u?\\Z")


def initials(turns):
    return "".join(r[:1] or "?" for r, _ in turns)


def exhaustive(rows):
    """Least (cost, audit, turns) of all audits with at most two insertions in a row."""
    best = [(10**9, "", [])]

    def go(at, spent, audit, out, inserted):
        if spent > best[0][0] or not BEGINNING.match(initials(out)):
            return
        if at == len(rows) and GRAMMAR.match(initials(out)):
            best[0] = min(best[0], (spent, audit, out))
        if inserted < 2:
            for role in ("user", "assistant"):
                go(at, spent + 2, audit + "I", [*out, (role, "")], inserted + 1)
        if at == len(rows):
            return
        role, text, fault = rows[at]
        go(at + 1, spent + 3, audit + "D", out, 0)
        if fault not in ("blank", "duplicate"):
            more = fault == "truncated"
            go(at + 1, spent + more, audit + "K", [*out, (role, text)], 0)
            for new in ("user", "assistant"):
                go(at + 1, spent + 2 + more, audit + "R", [*out, (new, text)], 0)

    go(0, 0, "", [], 0)
    return best[0]


def report(turns, search=exhaustive):
    """Rows of one dialogue (turn, role, text), in any order."""
    turns = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in turns]
    turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
    seen, rows = set(), []
    for _, role, text in turns:
        last = text.rstrip(" \t\n\x0b\f\r")[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else None if last in ".!?" else "truncated"
        seen.add((role, text))
        rows.append((role, text, fault))
    numbers = {t for t, _, _ in turns if t is not None}
    firsts = [r[:1] for r, _, _ in rows]
    legal = {("s", "u"), ("u", "a"), ("a", "u")}
    cost, audit, out = search(rows)
    return (
        max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
        *(sum(f == fault for _, _, f in rows) for fault in ("blank", "duplicate", "truncated")),
        sum(p not in legal for p in zip(firsts, firsts[1:], strict=False)),
        cost,
        audit,
        hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest(),
    )


def random_rows(seed, dialogues, longest):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "Why?", "cut off", " ", "", None, "Ends. \n", "é", "end "]
    out = []
    for conv in range(dialogues):
        for turn in range(rng.randrange(longest + 1)):
            number = rng.choice([turn, turn, turn, turn + 2, None])
            text = rng.choice(texts) if rng.random() < 0.5 else f"text {conv} {turn}."
            out.append((conv, number, rng.choice(roles), text))
    return out


def reported(spark, rows, **more):
    found = st.structure_report(spark.createDataFrame(rows, SCHEMA).repartition(3), **more).collect()
    assert len({r[0] for r in found}) == len(found)
    return {r[0]: tuple(r[1:6]) + (r.cost, r.audit, r.repaired_sha256) for r in found}


def by_dialogue(rows):
    out = {}
    for conv, *turn in rows:
        out.setdefault(conv, []).append(tuple(turn))
    return out


def test_every_signature_against_exhaustive_search():
    rng = random.Random(1)
    signs = {"s": ("system", "a.", None), "U": ("user", "b", "truncated"), "u": ("user", "b.", None), "x": ("tool", "", "blank"),
             "a": ("assistant", "c.", None), "o": ("tool", "d.", None), "A": ("assistant", "c", "truncated")}
    automaton = st.SuffixAutomaton()
    for _ in range(400):
        sign = "".join(rng.choices("sUuxaoA", k=rng.randrange(5)))
        rows = [signs[c] for c in sign]
        automaton.read(sign)
        audit, state = automaton.walk()
        turns = st.repaired(audit, [r for r, _, _ in rows], [t for _, t, _ in rows])
        assert (automaton.path[-1][0][st.START], audit, turns) == exhaustive(rows), sign
        assert st.cost(audit, sign) == automaton.path[-1][0][st.START]
        assert state in (st.START, st.AFTER_ASSISTANT)


def test_a_shared_suffix_is_read_once():
    automaton = st.SuffixAutomaton()
    for sign in sorted(("suaua", "uaua", "xuaua", "ua", "a"), key=lambda s: s[::-1]):
        automaton.read(sign)
    assert automaton.made == len("uaua") + len("s") + len("x")


def test_small_dialogues_against_exhaustive_search(spark):
    rows = random_rows(3, 60, 5)
    assert reported(spark, rows) == {c: report(t) for c, t in by_dialogue(rows).items()}


@pytest.mark.parametrize("most", [1, 3, 2048])
def test_chunks_make_no_difference(spark, most):
    rows = random_rows(5, 12, 60)

    def whole(rows):
        sign = "".join(
            "x" if f in ("blank", "duplicate") else (c.upper() if f else c)
            for r, _, f in rows
            for c in [r[:1] if r[:1] in ("s", "u", "a") else "o"]
        )
        automaton = st.SuffixAutomaton()
        automaton.read(sign)
        audit, _ = automaton.walk()
        turns = st.repaired(audit, [r for r, _, _ in rows], [t for _, t, _ in rows])
        return automaton.path[-1][0][st.START], audit, turns

    assert reported(spark, rows, most=most) == {c: report(t, whole) for c, t in by_dialogue(rows).items()}


def test_repaired_turns_follow_the_grammar_and_keep_their_order(spark):
    rows = random_rows(7, 20, 9)
    table = spark.createDataFrame(rows, SCHEMA)
    hashes = {c: r[-1] for c, r in reported(spark, rows).items()}
    for most in (2, 2048):
        turns = st.repaired_turns(table, most=most).orderBy("conv_id", "part", "place").collect()
        texts = {c: [] for c in hashes}
        for r in turns:
            texts[r.conv_id].append((r.role, r.text))
        for conv, left in texts.items():
            assert GRAMMAR.match(initials(left))
            assert hashlib.sha256("\n".join(f"{r}:{x}" for r, x in left).encode()).hexdigest() == hashes[conv]


def test_odd_input(spark):
    long_ = "word " * 300_000 + "end."
    rows = [
        (None, 1, "user", "No id."), (None, None, None, None), (1, None, "user", long_), (1, 1, "assistant", long_),
        (2, -(2**63), "user", "a."), (2, 2**63 - 1, "assistant", "b."), (3, 5, "user", "same."), (3, 5, "user", "same."),
        (4, None, "user", "x."), (4, None, "assistant", "y."),
    ]
    table = spark.createDataFrame(rows, SCHEMA)
    for name in ("name", "conv", "part", "row", "sign", "present", "last", "audit"):
        table = table.withColumn(name, F.lit("own"))
    found = {r.conv_id: r for r in st.structure_report(table).collect()}
    wanted = {c: report(t) for c, t in by_dialogue(rows).items()}
    wanted[2] = (2**63 - 1, *wanted[2][1:])  # more than fit
    assert {c: tuple(r[1:6]) + (r.cost, r.audit, r.repaired_sha256) for c, r in found.items()} == wanted
    renamed = spark.createDataFrame(rows, SCHEMA).toDF("my id", "name", "conv", "sign")
    again = st.structure_report(renamed, conv="my id", turn="name", role="conv", text="sign").collect()
    assert {r["my id"]: r.audit for r in again} == {c: r[-2] for c, r in wanted.items()}


def test_dialogues_without_turns_and_empty_tables(spark):
    assert reported(spark, []) == {}
    rows = [(1, 1, "user", "Gone."), (1, 2, "user", "Gone too."), (2, 1, "user", "Here.")]
    found = reported(spark, rows, present=F.col("conv_id") == 2)
    assert found[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found[2][-2] == "KI"
