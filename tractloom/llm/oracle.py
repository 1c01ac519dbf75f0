"""Corpus queries once more in DuckDB SQL, written from their meaning over whole tables."""

from __future__ import annotations

from tractloom.llm import chat, decontaminate, mixing, quality, repeats, urls

_SPACE = "[ \\t\\n\\x0B\\f\\r]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '{_SPACE}+'), lambda w: w <> '')"


def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# --- repeated passages: every 100-byte string as hexadecimal text ------------------------------------------------
_N = repeats.LENGTH
OP3 = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT *, length(h) // 2 AS n FROM d),
w AS (
  SELECT doc_id, p, md5(substr(h, CAST(2 * p + 1 AS BIGINT), {2 * _N})) AS s
  FROM (SELECT *, unnest(range(0, n - {_N} + 1)) AS p FROM n WHERE n >= {_N})
),
later AS (
  SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1
),
runs AS (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {_N} THEN 0 ELSE 1 END AS begins
  FROM later
),
spans AS (
  SELECT doc_id, min(p) AS b, max(p) + {_N} AS e
  FROM (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM runs)
  GROUP BY doc_id, span
),
gaps AS (
  SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS before FROM spans
),
cut AS (
  SELECT n.doc_id, sum(e - b) AS removed, count(*) AS spans, max(e) AS last,
         string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (b - before) AS BIGINT)), '' ORDER BY b) AS kept
  FROM gaps JOIN n ON n.doc_id = gaps.doc_id GROUP BY n.doc_id
)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM n LEFT JOIN cut ON cut.doc_id = n.doc_id
"""

# --- dialogues from every speaker's view ------------------------------------------------------------------------
_HEADER = (
    f"CASE WHEN t.role = '{chat.SYSTEM}' THEN {_text(chat.START + chat.SYSTEM)} || chr(10) "
    f"WHEN t.role = s.role THEN {_text(chat.START + 'assistant')} || chr(10) "
    f"ELSE {_text(chat.START + 'user name=')} || t.role || chr(10) END"
)
OP5 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         (row_number() OVER (PARTITION BY conv_id
            ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) - 1) // {chat.PART} AS part
  FROM conversations WHERE conv_id IS NOT NULL
),
s AS (SELECT DISTINCT conv_id, role FROM t WHERE role <> '{chat.SYSTEM}'),
v AS (
  SELECT s.conv_id, s.role AS speaker, t.part, t.turn, t.role, t.text,
         {_HEADER} || t.text || {_text(chat.END.strip())} || chr(10) AS piece
  FROM s JOIN t ON t.conv_id = s.conv_id
),
o AS (
  SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY conv_id, speaker, part
            ORDER BY turn NULLS LAST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            + {len(chat.START + 'assistant') + 1} AS begins
  FROM v
)
SELECT conv_id, speaker, part, count(*) AS n_turns, count(*) FILTER (role = speaker) AS n_own,
       string_agg(piece, '' ORDER BY turn NULLS LAST, role, text) AS rendered,
       coalesce(string_agg(CAST(begins AS VARCHAR) || ':' || CAST(begins + length(text) AS VARCHAR), ',' ORDER BY begins)
         FILTER (role = speaker), '') AS mask
FROM o GROUP BY conv_id, speaker, part
"""


# --- URL rules --------------------------------------------------------------------------------------------------
def _rules() -> str:
    rows = ", ".join(f"({_text(v)}, {_text(h)}, {_text(p)})" for v, h, p in urls.RULES)
    return f"SELECT * FROM (VALUES {rows}) AS r(verdict, rule_host, rule_path)"


OP6 = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages
),
u AS (
  SELECT page_id, {_lower("regexp_extract(rest, '^[^/?#]*', 0)")} AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
),
rules AS ({_rules()}),
fits AS (
  SELECT page_id, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, rule_host || rule_path) AS k
  FROM u JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
),
best AS (SELECT page_id, rule, verdict FROM fits WHERE k = 1),
listed AS (
  SELECT host FROM u LEFT JOIN best USING (page_id) GROUP BY host
  HAVING count(*) FILTER (verdict = 'block') > count(*) FILTER (verdict = 'allow')
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN host IN (SELECT host FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN best USING (page_id)
"""

# --- mixing -----------------------------------------------------------------------------------------------------
_WEIGHTS = "[" + ", ".join(map(str, mixing.WEIGHTS)) + "]"
OP7 = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len({_words('text')}) AS BIGINT) AS size FROM documents
),
keyed AS (
  SELECT *, CAST('0x' || substr(md5(concat_ws(':', CAST(doc_id AS VARCHAR), source, CAST(size AS VARCHAR))), 1,
         {mixing.KEY_DIGITS}) AS BIGINT) AS key FROM sized
),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM totals),
weighed AS (
  SELECT *, {_WEIGHTS}[(rank - 1) % {len(mixing.WEIGHTS)} + 1] AS weight,
         source_size * {mixing.MOST_PASSES} AS stop FROM ranked
),
levels AS (
  SELECT *,
    (CAST(sum(source_size) OVER () AS DOUBLE) * {mixing.SHARE} - CAST(coalesce(sum(stop) OVER before, 0) AS DOUBLE))
      / CAST(sum(weight) OVER onward AS DOUBLE) AS level,
    row_number() OVER reach AS place
  FROM weighed
  WINDOW reach AS (ORDER BY stop / weight, rank),
         before AS (ORDER BY stop / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         onward AS (ORDER BY stop / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
),
chosen AS (SELECT place AS first, level FROM levels WHERE level * weight <= stop ORDER BY place LIMIT 1),
goals AS (
  SELECT source, source_size, rank,
         CASE WHEN place < first THEN CAST(stop AS DOUBLE) ELSE chosen.level * weight END AS target
  FROM levels, chosen
),
queued AS (
  SELECT doc_id, size, source_size, rank, target,
         CAST(sum(size) OVER (PARTITION BY k.source ORDER BY key, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
  FROM keyed k JOIN goals g ON k.source IS NOT DISTINCT FROM g.source
),
entries AS (
  SELECT *, CAST(cum + turn * source_size AS DOUBLE) / target AS finish
  FROM queued, range({mixing.MOST_PASSES}) AS p(turn) WHERE size > 0
),
spent AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, cum, turn ROWS UNBOUNDED PRECEDING) AS upto FROM entries
),
given AS (
  SELECT doc_id, CAST(sum(greatest(0, least(size,
         (SELECT CAST(floor(sum(size) * {mixing.SHARE}) AS BIGINT) FROM sized) - (upto - size)))) AS BIGINT) AS taken
  FROM spent GROUP BY doc_id
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM queued LEFT JOIN given USING (doc_id)
"""

# --- decontamination --------------------------------------------------------------------------------------------
_RUNS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_W = decontaminate.WINDOW
OP9 = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_lower('text')}, {_RUNS}) AS ws FROM benchmark),
patterns AS (
  SELECT DISTINCT item, least(len(ws), {_W}) AS size, array_to_string(ws[p : p + {_W} - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - {_W} + 1, 1) + 1)) AS p FROM b WHERE len(ws) > 0)
),
d AS (SELECT doc_id, regexp_extract_all({_lower('text')}, {_RUNS}) AS ws FROM documents),
wins AS (
  SELECT doc_id, p, size, array_to_string(ws[p : p + size - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS p FROM d), (SELECT DISTINCT size FROM patterns)
  WHERE p + size - 1 <= len(ws)
),
found AS (SELECT doc_id, p, wins.size, item FROM wins JOIN patterns USING (size, win)),
hits AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + size)) AS spot FROM (SELECT DISTINCT doc_id, p, size FROM found))
  GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(joined, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {decontaminate.SHARE} * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# --- quality rules ----------------------------------------------------------------------------------------------
_SYMBOLS = "[" + "".join("\\" + c for c in quality.SYMBOLS) + "]"
_WIN = quality.WINDOW


def _points(keys: str) -> str:
    """Documents and, for each rate, the buckets at the percentiles, of each group."""
    lists, points = [], []
    for rate, (counted, per, _, _) in quality.RATES.items():
        units = f"CAST({counted} * {quality.UNIT} // greatest({per}, 1) AS BIGINT)"
        extra = f"greatest(length(bin({units})) - {quality.BITS}, 0)"
        lists.append(f"list_sort(list(({units} >> {extra}) << {extra})) AS {rate}")
        at = [f"{rate}[(n * {p} + 99) // 100]" for p in (quality.LOW, quality.MIDDLE, quality.HIGH)]
        points.append(f"[{', '.join(at)}] AS {rate}")
    group = f"GROUP BY {keys.rstrip(', ')}" if keys else ""
    inner = f"SELECT {keys} count(*) AS n, {', '.join(lists)} FROM rated WHERE NOT base_failed {group}"
    return f"SELECT {keys} n, {', '.join(points)} FROM ({inner})"


def _inside() -> str:
    tests = []
    for rate, (counted, per, chance, both) in quality.RATES.items():
        q = f"(CASE WHEN g.n >= {quality.MIN_GROUP} THEN g.{rate} WHEN l.n >= {quality.MIN_GROUP} THEN l.{rate} ELSE c.{rate} END)"
        units, more = f"r.{counted} * {quality.UNIT}", chance * quality.UNIT
        tests.append(f"{units} <= ({q}[3] + {quality.REACH} * ({q}[3] - {q}[2])) * r.{per} + {more}")
        if both:
            tests.append(f"{units} >= ({q}[1] - {quality.REACH} * ({q}[2] - {q}[1])) * r.{per} - {more}")
    return " AND ".join(tests)


OP10 = f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, {_words('t')} AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS ls
  FROM d
),
wins AS (
  SELECT doc_id, p, array_to_string(ws[p : p + {_WIN - 1}], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(ws) - {_WIN} + 2)) AS p FROM w WHERE len(ws) >= {_WIN})
),
twice AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1),
rep AS (
  SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest(range(p, p + {_WIN})) AS spot FROM twice)
  GROUP BY doc_id
),
counts AS (
  SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '{_SYMBOLS}')) AS BIGINT) AS n_symbols,
         len(ls) AS n_lines, CAST(len(ls) - list_unique(ls) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id
),
rated AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM counts
),
g AS ({_points('lang, source,')}),
l AS ({_points('lang,')}),
c AS ({_points('')})
SELECT r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
       NOT r.base_failed AND coalesce({_inside()}, false) AS kept
FROM rated r
LEFT JOIN g ON r.lang IS NOT DISTINCT FROM g.lang AND r.source IS NOT DISTINCT FROM g.source
LEFT JOIN l ON r.lang IS NOT DISTINCT FROM l.lang
CROSS JOIN c
"""

# --- hard negatives: all scores of all anchors ------------------------------------------------------------------
OP11 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS alike,
         CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND (a.vec_id <> b.vec_id OR a.label <> b.label)
),
p AS (
  SELECT anchor, other AS positive, score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5
),
n AS (
  SELECT p.anchor, positive, p.score AS positive_score, other, s.score,
         row_number() OVER (PARTITION BY p.anchor, positive ORDER BY s.score DESC, other) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT alike AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(rank AS INTEGER) AS rank, other AS negative_id, positive_score,
       score AS negative_score
FROM n WHERE rank <= 5
"""

# --- repair of dialogues: from the last turn to the first, the best of all audits and what it leaves --------------
_KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
#: CRC-32 bit by bit: each character is followed by seven steps without a character.
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform("
    f"string_split({_KEY}, ''), lambda ch: [CAST(unicode(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), "
    "lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))))"
)


def _way(state: int, price: str, letter: str, turn: str) -> str:
    """An edit in front of the best way from a state: what it costs, its audit, and the turns that are left."""
    return f"{{'c': {price} + d.w{state}.c, 'e': '{letter}' || d.w{state}.e, 'o': {turn} || d.w{state}.o}}"


def _inserted(state: int, role: str) -> str:
    return f"{{'c': 2 + b{state}.c, 'e': 'I' || b{state}.e, 'o': '{role}:' || chr(10) || b{state}.o}}"


def _best(state: int) -> str:
    wanted, step = ("assistant", 3) if state == 2 else ("user", 2)
    keeps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[state]
    kept = " ".join(
        f"WHEN initial = '{i}' THEN [{_way(t, 'unfinished', 'K', 'role || chr(58) || text || chr(10)')}]"
        for i, t in keeps.items()
    )
    renamed = _way(step, "2 + unfinished", "R", f"'{wanted}:' || text || chr(10)")
    free = f"[{renamed}] || CASE {kept} ELSE [] END"
    return f"list_min([{_way(state, '3', 'D', chr(39) * 2)}] || CASE WHEN must_go THEN [] ELSE {free} END) AS b{state}"


_NO_TURNS = (
    "{'c': 0, 'e': '', 'o': ''} AS w0, {'c': 4, 'e': 'II', 'o': 'user:' || chr(10) || 'assistant:' || chr(10)} AS w1, "
    "{'c': 2, 'e': 'I', 'o': 'assistant:' || chr(10)} AS w2, {'c': 0, 'e': '', 'o': ''} AS w3"
)
OP13 = f"""
WITH RECURSIVE cases AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, CAST({_CRC} AS BIGINT) % 20 AS k
  FROM conversations
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM cases WHERE k <> 0
),
turns AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         lead(left(role, 1)) OVER w AS next_initial, left(role, 1) AS initial,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
         right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
),
faults AS (
  SELECT *, last = '' AS blank, last <> '' AND seen > 1 AS duplicate,
         last <> '' AND seen = 1 AND last NOT IN ('.', '!', '?') AS truncated,
         initial || next_initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM turns
),
signs AS (
  SELECT *, blank OR duplicate AS must_go, CASE WHEN truncated THEN 1 ELSE 0 END AS unfinished FROM faults
),
d AS (
  SELECT conv_id, n + 1 AS i, {_NO_TURNS} FROM (SELECT conv_id, n FROM signs WHERE i = 1)
  UNION ALL
  SELECT conv_id, i,
         list_min([b0, {_inserted(2, "user")}, {{'c': 4 + b3.c, 'e': 'II' || b3.e,
                   'o': 'user:' || chr(10) || 'assistant:' || chr(10) || b3.o}}]),
         list_min([b1, {_inserted(2, "user")}, {{'c': 4 + b3.c, 'e': 'II' || b3.e,
                   'o': 'user:' || chr(10) || 'assistant:' || chr(10) || b3.o}}]),
         list_min([b2, {_inserted(3, "assistant")}]),
         list_min([b3, {_inserted(2, "user")}])
  FROM (SELECT s.conv_id, s.i, {_best(0)}, {_best(1)}, {_best(2)}, {_best(3)}
        FROM d JOIN signs s ON s.conv_id IS NOT DISTINCT FROM d.conv_id AND s.i = d.i - 1)
),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
         count_if(duplicate) AS duplicate, count_if(truncated) AS truncated, count_if(illegal) AS illegal
  FROM signs GROUP BY conv_id
)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(d.w0.c, 0) AS BIGINT) AS cost,
       coalesce(d.w0.e, '') AS audit,
       sha256(coalesce(left(d.w0.o, greatest(length(d.w0.o) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN d ON d.conv_id IS NOT DISTINCT FROM a.conv_id AND d.i = 1
"""

ORACLE_SQL: dict[str, str] = {
    "op3_repeated_passages": OP3,
    "op5_chat_formatting": OP5,
    "op6_url_filters": OP6,
    "op7_source_mixing": OP7,
    "op9_decontamination": OP9,
    "op10_quality_rules": OP10,
    "op11_hard_negatives": OP11,
    "op13_conversation_repair": OP13,
}
