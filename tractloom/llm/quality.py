"""Quality rules whose thresholds come from the corpus: one set per language and source.

Every document gets counts. For each rate a group's quantile sketch counts documents by bucket: whole numbers whose
leading eight bits are kept, so a quantile is off by less than one in a hundred, sketches merge by adding counts, and
no order of the rows changes them. Sketches are made per (language, source) and added up per language and over all.
A rate's fence lies as many times the distance from the median to the upper tenth beyond that tenth as REACH says, and
for lengths of words likewise below; nothing else decides but what short documents may have by chance, a few symbols,
characters, lines or words. Documents that fail the base rules are in no sketch.

Texts of any length are read whole, each within its own row.

Nulls and odd input: a null text has no words and fails; null languages or sources are a group like any other; empty
tables give empty results; repeated rows are judged alike, each on its own row. A rate at its fence passes. Added
columns replace input columns of the same name; all others pass through, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tractloom.llm.common import SPACES, col, settle, unpacked, whole, words

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Rates are whole numbers of one over UNIT; sketches keep their leading BITS bits.
UNIT = 10_000
BITS = 8
#: Groups with fewer documents take the thresholds of their language, then of the corpus.
MIN_GROUP = 200
#: Percentiles of a sketch, and how many times the outer distance a fence lies beyond the outer one.
LOW, MIDDLE, HIGH = 10, 50, 90
REACH = 3
#: rate: (counted, per, what a short document may have by chance, whether low values are refused too)
RATES = {
    "symbol_rate": ("n_symbols", "n_words", 3, False),
    "word_length": ("word_chars", "n_words", 20, True),
    "dup_line_rate": ("n_dup_lines", "n_lines", 1, False),
    "repeat_rate": ("n_repeat_words", "n_words", 2 * WINDOW, False),
}
#: Thresholds of up to so many groups are copied to every task; more are joined by a salted shuffle.
BROADCAST_GROUPS = 100_000
SALTS = 16


def counted(docs: DataFrame, text: str, carried: list[str]) -> DataFrame:
    """`doc` (the carried columns as a struct) and the counts of each document.

    Equal windows of five words are found by 64-bit hashes within one document, without leaving its row.
    """
    first = docs.select(
        whole(docs.select(*map(col, carried))).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("body")
    )
    split = first.select(
        "doc",
        words(F.col("body")).alias("words"),
        F.filter(F.split("body", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "").alias("lines"),
        F.length(F.translate("body", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    w = F.col("words")
    hashed = split.select(
        "doc",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.slice(
            F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)])),
            F.lit(1),
            F.greatest(F.size(w) - (WINDOW - 1), F.lit(0)),
        ).alias("windows"),
    )
    keep = ["doc", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    ordered = hashed.select(
        *keep,
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("ordered"),
    )
    o = F.col("ordered")

    def twice(x: Column, j: Column) -> Column:
        same = [F.coalesce(F.get(o, j + k)["h"] == x["h"], F.lit(False)) for k in (-1, 1)]
        return same[0] | same[1]

    starts = ordered.select(
        *keep, F.sort_array(F.transform(F.filter(o, twice), lambda x: x["i"])).alias("starts")
    )
    s = F.col("starts")
    reach = F.transform(s, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(s, j + 1) - p, F.lit(WINDOW))))
    return starts.select(
        *keep,
        F.coalesce(F.aggregate(reach, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )


def _rates() -> list[Column]:
    return [
        (F.col(counted_) / F.greatest(F.col(per), F.lit(1)).cast("double")).alias(rate)
        for rate, (counted_, per, _, _) in RATES.items()
    ]


def _bucket(counted_: str, per: str) -> Column:
    """The rate in UNITs with all but its leading bits cleared."""
    units = F.call_function("div", F.col(counted_) * UNIT, F.greatest(F.col(per), F.lit(1)).cast("long"))
    extra = F.greatest(F.length(F.bin(units)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", units, extra), extra)


def sketches(rated: DataFrame) -> DataFrame:
    """(lang, source, rate, bucket, n): documents of each group by bucket, counted in the tasks before they move."""
    entries = [
        F.struct(F.lit(i).alias("rate"), _bucket(counted_, per).alias("bucket"))
        for i, (counted_, per, _, _) in enumerate(RATES.values())
    ]
    each = rated.filter("NOT base_failed").select("lang", "source", F.inline(F.array(*entries)))
    return each.groupBy("lang", "source", "rate", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _percentiles(counts: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """For each group its documents and, for each rate, the buckets at the three percentiles."""
    merged = counts.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*keys, "rate")
    upto = group.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = merged.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(group)})
    at = [
        F.min(F.when((F.col("rate") == i) & (F.col("upto") * 100 >= F.col("all") * p), F.col("bucket"))).alias(str(p))
        for i in range(len(RATES))
        for p in (LOW, MIDDLE, HIGH)
    ]
    points = [F.struct(*at[3 * i : 3 * i + 3]).alias(prefix + rate) for i, rate in enumerate(RATES)]
    return ranked.groupBy(*keys).agg(F.max("all").alias(f"{prefix}n"), *points)


def fences(rated: DataFrame) -> DataFrame:
    """Low and high fence of every rate, in UNITs, for each (lang, source) that occurs.

    Groups too small to have a spread of their own use what their language or the corpus says.
    """
    counts = settle(sketches(rated), "sketches")
    groups = settle(rated.select("lang", "source").distinct(), "groups")
    fine = _percentiles(counts, ["lang", "source"], "g_").withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    language = _percentiles(counts, ["lang"], "l_").withColumnRenamed("lang", "l_lang")
    corpus = _percentiles(counts, [], "c_").select(F.struct(*[f"c_{r}" for r in RATES])).scalar()
    joined = (
        groups.join(fine, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
        .join(language, F.col("lang").eqNullSafe(F.col("l_lang")), "left")
        .withColumn("corpus", corpus)
    )

    def chosen(r: str) -> Column:
        return (
            F.when(F.col("g_n") >= MIN_GROUP, F.col(f"g_{r}"))
            .when(F.col("l_n") >= MIN_GROUP, F.col(f"l_{r}"))
            .otherwise(F.col(f"corpus.c_{r}"))
        )

    bounds = []
    for r in RATES:
        low, middle, high = (chosen(r)[str(p)] for p in (LOW, MIDDLE, HIGH))
        bounds += [
            (low - REACH * (middle - low)).alias(f"{r}_low"),
            (high + REACH * (high - middle)).alias(f"{r}_high"),
        ]
    return joined.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), *bounds)


def with_fences(rated: DataFrame, limits: DataFrame, most: int = BROADCAST_GROUPS) -> DataFrame:
    """Each document beside its group's fences, by a broadcast whose size is checked or a salted join."""
    limits = settle(limits, "fences")
    same = F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source"))
    if limits.count() <= most:
        return rated.join(F.broadcast(limits), same, "left")
    salted = limits.withColumn("f_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = rated.withColumn("salt", F.pmod(F.xxhash64("word_chars", "n_words", "n_lines"), F.lit(SALTS)).cast("int"))
    return spread.join(salted, same & (F.col("salt") == F.col("f_salt")), "left")


def quality_verdicts(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    carried: list[str] | None = None,
    most: int = BROADCAST_GROUPS,
) -> DataFrame:
    """The carried columns (all, unless named), the counts, the rates, `base_failed` and `kept`.

    Counting happens once: its result, with the carried columns, is settled, and both the sketches and the verdicts
    read from it what they need. Columns added here replace input columns of the same name.
    """
    names = docs.columns if carried is None else carried
    groups = F.struct(col(lang).cast("string").alias("lang"), col(source).cast("string").alias("source"))
    work = docs.select(*[col(n).alias(f"c{i}") for i, n in enumerate(names)], groups.alias("g"), col(text).alias("t"))
    carry = [f"c{i}" for i in range(len(names))]
    rated = settle(
        counted(work, "t", [*carry, "g"]).select(
            F.struct(*[F.col(f"doc.{c}").alias(n) for c, n in zip(carry, names, strict=True)]).alias("doc"),
            "doc.g.lang", "doc.g.source", "n_lines", *COUNTS, *_rates(), base_failed().alias("base_failed"),
        ),
        "quality",
    )
    judged = with_fences(rated, fences(rated), most)
    inside = []
    for r, (counted_, per, chance, both) in RATES.items():
        units, base = F.col(counted_) * UNIT, F.col(per).cast("long")
        inside.append(F.coalesce(units <= F.col(f"{r}_high") * base + chance * UNIT, F.lit(False)))
        if both:
            inside.append(F.coalesce(units >= F.col(f"{r}_low") * base - chance * UNIT, F.lit(False)))
    verdict = judged.withColumn("kept", ~F.col("base_failed") & reduce(Column.__and__, inside))
    return unpacked(verdict, "doc", names, [*COUNTS, *RATES, "base_failed", "kept"])


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns only."""
    judged = quality_verdicts(docs.select(whole(docs).alias("d"), "text", "lang", "source"), carried=["d"])
    return unpacked(judged.filter("kept"), "d", docs.columns)
