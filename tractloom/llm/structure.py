"""Repair of conversation structure: the cheapest edits that make the roles of a dialogue follow its grammar.

Grammar. Roles count by their first character. A dialogue is empty, or an optional system turn and then user and
assistant in turn, ending with the assistant: `(s?(ua)+)?`.

Faults. A turn is blank, or a duplicate of an earlier one, or truncated (its last character ends no sentence); its first
fault counts. Edits: keep a turn (0), give it the role that the grammar wants (2), delete it (3; blank turns and
duplicates must go), insert an empty turn of the role that the grammar wants (2). A truncated turn that stays costs 1
more. The edits' initials are the audit; of the cheapest audits the least one in ASCII order is taken.

How. A turn's signature is one character: what its fault allows and which role it has. A dialogue's signature is read
from its end: the automaton's node for a suffix holds, for every grammar state, the cost to go and the first edit of
the best audit; its further edits are the next node's, so an audit suffix is stored once as a chain. As the four edits
have different initials, the first edit decides every tie. Signatures of all dialogues are sorted by their reversed
text in ranges, so equal suffixes are adjacent, and a node is computed once however many dialogues share it; a task
keeps the nodes of the current signature alone.

Long dialogues. Turns are sorted over the whole table and packed into chunks of bounded size. A dialogue that is in
several chunks, or at the edge of a task's turns, is put together by walking its chunks: from the end for the costs to
go behind each chunk, from the start for the state before it and for the hash, whose order no task can change. Nothing
holds more than a chunk.

Nulls and odd input: a null role or text is one space; a null dialogue id is an id like any other; null turn numbers
come first. Turns of one number go by role, then text. An empty role has no
initial and is never kept. A dialogue without present turns has zeros and an empty repair.
An empty table gives no rows. Columns other than the four named ones play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractloom.llm.common import SPACES, col, settle

#: A chunk ends at so many turns or characters of text.
CHUNK = 2048
CHUNK_CHARS = 1 << 20

SYSTEM, USER, ASSISTANT = "system", "user", "assistant"
KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLED, DELETED, INSERTED, UNFINISHED = 2, 3, 2, 1
#: Signature of a turn that must go; of others the role's initial, `o` for further ones, in upper case if truncated.
MUST_GO = "x"
#: Grammar states: nothing yet, after system, after user, after assistant; and the state after each legal initial.
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
STEPS = (
    {"s": AFTER_SYSTEM, "u": AFTER_USER},
    {"u": AFTER_USER},
    {"a": AFTER_ASSISTANT},
    {"u": AFTER_USER},
)
#: The role that an insertion or a new role gives in each state.
WANTED = (USER, USER, ASSISTANT, USER)
#: Costs to go and first edits behind the last turn.
END_COSTS, END_EDITS = (0, 4, 2, 0), ("", INSERT, INSERT, "")


# --- the automaton -----------------------------------------------------------------------------------------------


@lru_cache(maxsize=100_000)
def node(symbol: str, behind: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """Costs to go and first edits, for each state, of a suffix that begins with a turn before a known suffix."""
    role, stays = symbol.lower(), UNFINISHED if symbol.isupper() else 0
    best = []
    for state in range(len(STEPS)):
        ways = [(DELETED + behind[state], DELETE)]
        if symbol != MUST_GO:
            if role in STEPS[state]:
                ways.append((stays + behind[STEPS[state][role]], KEEP))
            ways.append((REROLED + stays + behind[STEPS[state][WANTED[state][0]]], REROLE))
        best.append(min(ways))
    # An insertion leads to user or assistant at the same turn; two in a row from these come back and can't be best.
    user, assistant = best[AFTER_USER], best[AFTER_ASSISTANT]
    best[AFTER_USER] = min(user, (INSERTED + assistant[0], INSERT))
    best[AFTER_ASSISTANT] = min(assistant, (INSERTED + user[0], INSERT))
    for state in (START, AFTER_SYSTEM):
        best[state] = min(best[state], (INSERTED + best[AFTER_USER][0], INSERT))
    return tuple(c for c, _ in best), tuple(e for _, e in best)


class SuffixAutomaton:
    """Nodes of the current signature, from its end; those of the suffix shared with the last one are kept."""

    def __init__(self, costs: tuple[int, ...] = END_COSTS, edits: tuple[str, ...] = END_EDITS) -> None:
        self.path, self.turned = [(costs, edits)], ""
        self.made = 0

    def read(self, signature: str) -> None:
        turned, same = signature[::-1], 0
        for old, new in zip(self.turned, turned, strict=False):
            if old != new:
                break
            same += 1
        del self.path[same + 1 :]
        for symbol in turned[same:]:
            least = min(self.path[-1][0])
            costs, edits = node(symbol, tuple(c - least for c in self.path[-1][0]))
            self.path.append((tuple(c + least for c in costs), edits))
            self.made += 1
        self.turned = turned

    def walk(self, state: int = START) -> tuple[str, int]:
        """The best audit from a state, and the state in which it ends."""
        audit, at = [], len(self.turned)
        while edit := self.path[at][1][state]:
            audit.append(edit)
            if edit == INSERT:
                state = STEPS[state][WANTED[state][0]]
                continue
            at -= 1
            if edit == KEEP:
                state = STEPS[state][self.turned[at].lower()]
            elif edit == REROLE:
                state = STEPS[state][WANTED[state][0]]
        return "".join(audit), state


def repaired(audit: str, roles: list[str], texts: list[str], state: int = START) -> list[tuple[str, str]]:
    """The turns that an audit leaves."""
    out, at = [], 0
    for edit in audit:
        if edit == INSERT:
            out.append((WANTED[state], ""))
        elif edit == KEEP:
            out.append((roles[at], texts[at]))
        elif edit == REROLE:
            out.append((WANTED[state], texts[at]))
        if edit != INSERT:
            at += 1
        if edit != DELETE:
            state = STEPS[state][out[-1][0][0]]
    return out


def cost(audit: str, signature: str) -> int:
    total, at = 0, 0
    for edit in audit:
        if edit == INSERT:
            total += INSERTED
            continue
        if edit == DELETE:
            total += DELETED
        else:
            total += (REROLED if edit == REROLE else 0) + (UNFINISHED if signature[at].isupper() else 0)
        at += 1
    return total


# --- chunks ------------------------------------------------------------------------------------------------------

_TURN = T.ArrayType(T.StructType().add("role", T.StringType()).add("text", T.StringType()))
_COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def marked_turns(turns: DataFrame, names: tuple[str, str, str, str], present: Column) -> DataFrame:
    """conv, name, turn, role, text, row, initial, fault and signature of every turn; absent ones keep their id alone."""
    conv, turn, role, text = names
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    first = turns.select(
        col(conv).alias("conv"),
        col(conv).cast("string").alias("name"),
        col(turn).cast("long").alias("turn"),
        F.coalesce(col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(col(text).cast("string"), F.lit(" ")).alias("text"),
        F.coalesce(present, F.lit(False)).alias("present"),
        F.monotonically_increasing_id().alias("row"),
    )
    own = settle(first.withColumn("initial", F.substring("role", 1, 1)).withColumn("last", last), "turns")
    # The first of equal turns of a dialogue, found by partial minima; no number of equal ones meets in one task.
    place = F.struct("turn", "row")
    firsts = own.filter("present AND last <> ''").groupBy("name", "role", F.sha2("text", 256)).agg(F.min(place).alias("p"))
    leading = firsts.select(F.col("p.row").alias("row"), F.lit(True).alias("leads"))
    fault = (
        F.when(F.col("last") == "", "blank")
        .when(F.col("leads").isNull(), "duplicate")
        .when(~F.col("last").isin(".", "!", "?"), "truncated")
    )
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    signature = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).otherwise(
        F.when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)
    )
    return (
        own.join(leading, "row", "left").withColumn("fault", F.when(F.col("present"), fault)).withColumn("sign", signature)
    )


class _Chunk:
    def __init__(self, key, row: int) -> None:  # noqa: ANN001
        self.key, self.row, self.several, self.chars = key, row, False, 0
        self.signs, self.roles, self.texts, self.initials, self.turns = [], [], [], [], []
        self.faults = dict.fromkeys(_COUNTS, 0)

    def add(self, turn: dict) -> None:
        self.signs.append(turn["sign"])
        self.roles.append(turn["role"])
        self.texts.append(turn["text"])
        if turn["fault"]:
            self.faults[turn["fault"]] += 1
        if self.initials and (self.initials[-1], turn["initial"]) not in _LEGAL:
            self.faults["illegal"] += 1
        self.initials.append(turn["initial"])
        self.chars += len(turn["text"])
        if turn["turn"] is not None and (not self.turns or self.turns[-1] != turn["turn"]):
            self.turns.append(turn["turn"])


    def fields(self) -> dict:
        return self.faults | {
            "sign": "".join(self.signs), "roles": self.roles, "texts": self.texts,
            "first": self.initials[0] if self.initials else None, "final": self.initials[-1] if self.initials else None,
            "low": self.turns[0] if self.turns else None, "high": self.turns[-1] if self.turns else None,
            "numbers": len(self.turns), "several": self.several, "turned": "".join(self.signs)[::-1],
        }


_CHUNK_FIELDS = {
    "part": pa.int64(), **{c: pa.int64() for c in _COUNTS}, "sign": pa.string(), "roles": pa.list_(pa.string()),
    "texts": pa.list_(pa.string()), "first": pa.string(), "final": pa.string(), "low": pa.int64(), "high": pa.int64(),
    "numbers": pa.int64(), "several": pa.bool_(), "turned": pa.string(),
}
_CHUNK_SCHEMA = (
    "name string, part long, blank long, duplicate long, truncated long, illegal long, sign string, "
    "roles array<string>, texts array<string>, first string, final string, low long, high long, numbers long, "
    "several boolean, turned string"
)


def _pack(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Chunks of sorted turns. Dialogues that may go on in another task, or do in another chunk, are `several`."""
    task, number, size = TaskContext.get().partitionId() << 32, 0, 0
    open_: _Chunk | None = None
    ids: list = []
    done: list[dict] = []
    edge = True

    def close() -> None:
        nonlocal number, size
        done.append({"part": task + number} | open_.fields())
        size += open_.chars + 16 * len(open_.signs) + 256
        number += 1

    def batch() -> pa.RecordBatch:
        nonlocal size, ids, done
        arrays = [pa.array([d[k] for d in done], kind) for k, kind in _CHUNK_FIELDS.items()]
        out = pa.RecordBatch.from_arrays([pa.concat_arrays(ids[: len(done)]), *arrays], ["conv", *_CHUNK_FIELDS])
        ids, done, size = ids[len(done) :], [], 0
        return out

    for some in batches:
        convs = some.column("conv")
        columns = {k: some.column(k).to_pylist() for k in ("name", "turn", "role", "text", "initial", "fault", "sign", "present")}
        for i, name in enumerate(columns["name"]):
            if open_ is None or open_.key != name:
                if open_ is not None:
                    close()
                    edge = False
                open_ = _Chunk(name, i)
                open_.several = edge
                ids.append(convs.slice(i, 1))
            elif len(open_.signs) >= most or open_.chars >= CHUNK_CHARS:
                open_.several = True
                close()
                open_ = _Chunk(name, i)
                open_.several = True
                ids.append(convs.slice(i, 1))
            if columns["present"][i]:
                open_.add({k: v[i] for k, v in columns.items()})
            if size > 1 << 23:
                yield batch()
    if open_ is not None:
        open_.several = True
        close()
        yield batch()


def chunks(marked: DataFrame, most: int = CHUNK) -> DataFrame:
    """Dialogues in chunks of at most so many turns, whose `part` goes up with the order of turns."""
    order = ["name", "turn", "role", F.substring("text", 1, 32)]
    kind = T.StructType([marked.schema["conv"], *T.StructType.fromDDL(_CHUNK_SCHEMA).fields[1:]])
    ranged = marked.repartitionByRange(*order).sortWithinPartitions("name", "turn", "role", "text", "row")
    packed = ranged.select("conv", "name", "turn", "role", "text", "initial", "fault", "sign", "present")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pack(batches, most)

    return settle(packed.mapInArrow(pack, kind).withColumn("name", F.col("conv").cast("string")), "chunks")


# --- repair ------------------------------------------------------------------------------------------------------


def _with_columns(batch: pa.RecordBatch, audits: list[str], costs: list[int], turns: list) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    listed = pa.array([[{"role": r, "text": t} for r, t in own] for own in turns], kind)
    columns = [*batch.columns, pa.array(audits, pa.string()), pa.array(costs, pa.int64()), listed]
    return pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "audit", "cost", "repaired"])


def _few(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _repair_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dialogues of one chunk, sorted by their reversed signatures."""
    automaton = SuffixAutomaton()
    last, audit, price = None, "", 0
    for batch in _few(batches, 2000):
        audits, costs, turns = [], [], []
        for sign, roles, texts in zip(
            batch.column("sign").to_pylist(), batch.column("roles").to_pylist(), batch.column("texts").to_pylist(),
            strict=True,
        ):
            if sign != last:
                automaton.read(sign)
                audit, _ = automaton.walk()
                last, price = sign, automaton.path[-1][0][START]
            audits.append(audit)
            costs.append(price)
            turns.append(repaired(audit, roles, texts))
        yield _with_columns(batch, audits, costs, turns)


def _costs_behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs to go behind each chunk, from each dialogue's last chunk to its first."""
    name, costs, started = None, END_COSTS, False
    for batch in batches:
        out = {"part": [], "behind": [], "is_last": []}
        for own, part, sign in zip(*(batch.column(c).to_pylist() for c in ("name", "part", "sign")), strict=True):
            new = not started or own != name
            if new:
                name, costs, started = own, END_COSTS, True
            out["part"].append(part)
            out["behind"].append(list(costs))
            out["is_last"].append(new)
            automaton = SuffixAutomaton(costs, END_EDITS if new else ("",) * 4)
            automaton.read(sign)
            least = min(automaton.path[-1][0])
            # With its own base the numbers stay small; only their differences decide.
            costs = tuple(c - least for c in automaton.path[-1][0])
        yield pa.RecordBatch.from_pydict(out)


def _repair_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of long dialogues in order, each from the state that the one before it ended in."""
    state = START
    for batch in _few(batches, 8):
        audits, costs, turns = [], [], []
        rows = (batch.column(c).to_pylist() for c in ("sign", "roles", "texts", "behind", "is_last"))
        for sign, roles, texts, behind, is_last in zip(*rows, strict=True):
            automaton = SuffixAutomaton(tuple(behind), END_EDITS if is_last else ("",) * 4)
            automaton.read(sign)
            audit, end = automaton.walk(state)
            audits.append(audit)
            costs.append(cost(audit, sign))
            turns.append(repaired(audit, roles, texts, state))
            state = START if is_last else end
        yield _with_columns(batch, audits, costs, turns)


def repaired_chunks(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    present: Column | None = None,
    most: int = CHUNK,
) -> tuple[DataFrame, DataFrame]:
    """Chunks with `conv`, `part`, counts, `audit`, `cost` and `repaired`, the turns that are left of the chunk.

    The first table has dialogues of one chunk, the second those that may have several. `present` is false in rows that
    only name their dialogue; a chunk has `most` turns at most.
    """
    names = (conv, turn, role, text)
    cut = chunks(marked_turns(turns, names, F.lit(True) if present is None else present), most)
    kind = T.StructType(
        [*cut.schema.fields, T.StructField("audit", T.StringType()), T.StructField("cost", T.LongType()),
         T.StructField("repaired", _TURN)]
    )
    whole = cut.filter("NOT several").repartitionByRange("turned", "name").sortWithinPartitions("turned")
    long_ = cut.filter("several")
    behind = (
        long_.select("name", "part", "sign")
        .repartition("name")
        .sortWithinPartitions("name", F.desc("part"))
        .mapInArrow(_costs_behind, "part long, behind array<long>, is_last boolean")
    )
    met = long_.join(behind, "part").repartition("name").sortWithinPartitions("name", "part")
    long_kind = T.StructType([*met.schema.fields, *kind.fields[-3:]])
    parts = met.mapInArrow(_repair_parts, long_kind).select(kind.names)
    return whole.mapInArrow(_repair_whole, kind), parts


def repaired_turns(turns: DataFrame, **named) -> DataFrame:  # noqa: ANN003
    """The turns after repair: the dialogue's id, `part` and `place` (their order), `role` and `text`."""
    whole, parts = repaired_chunks(turns, **named)
    out = whole.unionByName(parts).select("conv", "part", F.posexplode("repaired").alias("place", "turn"))
    return out.select(F.col("conv").alias(named.get("conv", "conv_id")), "part", "place", "turn.role", "turn.text")


_REPORT = ["gaps", *_COUNTS, "cost"]


def _report_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each long dialogue: its chunks are read in order and put together."""
    name, started = None, False
    totals: dict = {}

    def result() -> pa.RecordBatch:
        numbers = totals["numbers"]
        gaps = totals["high"] - totals["low"] + 1 - numbers if numbers else 0
        row = {"gaps": min(gaps, 2**63 - 1), **{c: totals[c] for c in (*_COUNTS, "cost")}}
        arrays = [pa.array([v], pa.int64()) for v in row.values()]
        texts = [pa.array([totals["audit"].getvalue().decode()]), pa.array([totals["hash"].hexdigest()])]
        return pa.RecordBatch.from_arrays([totals["conv"], *arrays, *texts], ["conv", *row, "audit", "repaired_sha256"])

    for batch in _few(batches, 8):
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names if c != "conv"}
        for i in range(batch.num_rows):
            row = {k: v[i] for k, v in columns.items()}
            if not started or row["name"] != name:
                if started:
                    yield result()
                name, started = row["name"], True
                totals = dict.fromkeys((*_COUNTS, "cost", "numbers"), 0) | {
                    "conv": batch.column("conv").slice(i, 1), "hash": hashlib.sha256(), "audit": io.BytesIO(),
                    "low": None, "high": None, "final": None, "some": False,
                }
            for c in (*_COUNTS, "cost"):
                totals[c] += row[c]
            if row["first"] is not None:
                if totals["final"] is not None and (totals["final"], row["first"]) not in _LEGAL:
                    totals["illegal"] += 1
                totals["final"] = row["final"]
            if row["numbers"]:
                totals["numbers"] += row["numbers"] - (totals["high"] == row["low"])
                totals["low"] = row["low"] if totals["low"] is None else totals["low"]
                totals["high"] = row["high"]
            totals["audit"].write(row["audit"].encode())
            for turn in row["repaired"]:
                if totals["some"]:
                    totals["hash"].update(b"\n")
                totals["hash"].update(f"{turn['role']}:{turn['text']}".encode())
                totals["some"] = True
    if started:
        yield result()


def structure_report(turns: DataFrame, **named) -> DataFrame:  # noqa: ANN003
    """One row per dialogue: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    whole, parts = repaired_chunks(turns, **named)
    number = lambda c: F.col(c).cast("decimal(20,0)")
    some = number("high") - number("low") + 1 - number("numbers")
    gaps = F.when(F.col("numbers") == 0, 0).otherwise(F.least(some, F.lit(2**63 - 1))).cast("long")
    joined = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    short = whole.select(
        "conv", gaps.alias("gaps"), *_COUNTS, "cost", "audit",
        F.sha2(joined, 256).alias("repaired_sha256"),
    )
    kind = T.StructType(
        [whole.schema["conv"], *[T.StructField(c, T.LongType()) for c in _REPORT],
         T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
    )
    ordered = parts.drop("sign", "turned", "roles", "texts").repartition("name").sortWithinPartitions("name", "part")
    long_ = ordered.mapInArrow(_report_parts, kind)
    return short.unionByName(long_).withColumnRenamed("conv", named.get("conv", "conv_id"))
