"""Secrets in text, and credentials whose parts only count together.

Assignments, access ids and long hexadecimal runs are reported wherever they stand. Weak candidates (account names,
random-looking tokens, addresses of services) are reported only together with their complements. A scope is a stretch
of text without a blank line; parts are joined with the scope whose interval holds them, however long it is, and a part
counts if its complement lies in the same scope: an identifier needs a key, a key an identifier, an address both.
Scopes never cross documents, so the join needs no shuffle; each part finds its scope by bisection, and no part is
paired with another.

Texts are scanned whole, whatever their length, in time that grows with their length and the number of parts.

Nulls and odd input: a null or empty text has no spans; other columns pass through untouched; repeated rows are
scanned alike; an empty table stays empty. Of spans that begin at one place, the kind listed first comes first.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractloom.llm.common import unpacked, whole

#: Kinds in the order in which spans with one start are listed; the first three are always reported.
KINDS = ("assign", "access", "hex", "account", "key", "endpoint")
BASE = KINDS[:3]

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I
)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that are long enough

ACCOUNT = re.compile(
    r"""(?:client_?id|access_?key_?id|account|username|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""",
    re.A | re.I,
)
ACCOUNT_HINTS = ("client", "access", "account", "user", "login")
KEY = re.compile(r"(?<![A-Za-z0-9/+_-])[A-Za-z0-9/+_-]{20,}={0,2}(?![A-Za-z0-9/+_=-])", re.A)
ENDPOINT = re.compile(r"""[a-z][a-z0-9+.-]*://[^\s"'<>]+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:amazonaws|azure)\.com\b""", re.A)
BLANK_LINE = re.compile(r"\n[ \t\r]*\n")

SPAN_TYPE = T.ArrayType(
    T.StructType().add("kind", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType())
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of what is a secret on its own."""
    found = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def _random_looking(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)


def _overlaps(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether any of the sorted, disjoint spans shares a character with another one."""
    k = bisect_left(spans, (end, end))
    return k > 0 and spans[k - 1][1] > start


def _disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans; those that overlap become one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def linked_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak candidates with a complement in their scope."""
    accounts = []
    low = text.lower()
    if any(h in low for h in ACCOUNT_HINTS):
        accounts = [m.span() for m in ACCOUNT.finditer(text)]
    strong_ids = [(s, e) for s, k, e in base if k == 1]
    strong_keys = [(s, e) for s, k, e in base if k != 1]
    if not accounts and not strong_ids:
        return []  # every link has an identifier on one side
    taken = _disjoint([(s, e) for s, _, e in base])
    keys = [m.span() for m in KEY.finditer(text) if _random_looking(m[0]) and not _overlaps(taken, *m.span())]
    if not keys and not strong_keys:
        return []
    endpoints = [m.span() for m in ENDPOINT.finditer(text)]
    cuts = [m.end() for m in BLANK_LINE.finditer(text)]
    scopes: dict[int, tuple[list, list, list, list, list]] = {}
    for role, spans in enumerate((accounts, strong_ids, keys, strong_keys, endpoints)):
        for s, e in spans:
            scopes.setdefault(bisect_left(cuts, s + 1), ([], [], [], [], []))[role].append((s, e))
    found = []
    for weak_ids, ids, weak_keys, sure_keys, places in scopes.values():
        any_id, any_key = bool(weak_ids or ids), bool(weak_keys or sure_keys)
        found += [(s, 3, e) for s, e in weak_ids if any_key]
        found += [(s, 4, e) for s, e in weak_keys if any_id]
        found += [(s, 5, e) for s, e in places if any_id and any_key]
    return found


def all_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end), by start and then kind."""
    if not text:
        return []
    base = base_spans(text)
    return [(KINDS[k], s, e) for s, k, e in sorted(base + linked_spans(text, base))]


@F.pandas_udf(SPAN_TYPE)
def _spans(text: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in all_spans(t)] for t in text])


@F.pandas_udf(T.StringType())
def _redacted(text: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, found in zip(text, spans, strict=True):
        if t is None or not len(found):
            out.append(t)
            continue
        pieces, at = [], 0
        for span in found:
            if span["end"] <= at:
                continue
            if span["start"] >= at:
                pieces += [t[at : span["start"]], f"<{span['kind']}>"]
            at = span["end"]
        out.append("".join([*pieces, t[at:]]))
    return pd.Series(out, dtype=object)


def secret_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns and `secret_spans`: kind, start, end (code points, end exclusive), by start and then kind."""
    return docs.withColumn("secret_spans", _spans(F.col(text)))


def digest(spans: str = "secret_spans") -> list:
    """Counts of the base kinds and the spans as text."""

    def joined(kept):  # noqa: ANN001, ANN202
        texts = F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(texts, ",")

    def of(kinds):  # noqa: ANN001, ANN202
        return F.filter(spans, lambda s: s["kind"].isin(*kinds))

    base = of(BASE)
    return [
        *[F.size(of([k])).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col(spans)).alias("spans"),
    ]


def redacted_documents(docs: DataFrame) -> DataFrame:
    """Documents with every span replaced by its kind in angle brackets; all of them stay.

    Where there is a column `n_chars`, it becomes the length of the new text if that changed.
    """
    names = docs.columns
    first = docs.select(whole(docs).alias("d"), F.col("text").alias("body"))
    scanned = secret_spans(first, "body").withColumn(
        "text", F.when(F.size("secret_spans") > 0, _redacted("body", "secret_spans")).otherwise(F.col("body"))
    )
    added = ["text"]
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        scanned = scanned.withColumn(
            "n_chars",
            F.when(F.size("secret_spans") > 0, F.length("text").cast(kind)).otherwise(F.col("d.n_chars")),
        )
        added.append("n_chars")
    return unpacked(scanned, "d", names, added).select(*[F.col(f"`{n}`") for n in names])
