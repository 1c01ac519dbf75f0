"""A Bloom filter of keys as a small table, for dropping rows before they are aggregated and moved.

A key sets four bits of one 64-bit word. The filter is the table of words that have bits, at most ``WORDS`` of them
whatever the number of keys, which is what allows its broadcast. Words are or-ed together, so filters of parts of the
keys merge, and the map side does most of it. Keys are never lost; other rows pass by chance, the more the fuller the
filter is, so that with very many keys it only stops being of use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractloom.operators.projection import quoted

#: 64-bit words of a filter; about 10 bits a key at 800,000 keys, 2 MB with the words' numbers.
WORDS = 1 << 17


def _word(key: Column, words: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 40).bitwiseAND(F.lit(words - 1)).cast("int")


def _bits(key: Column) -> Column:
    spot = F.xxhash64(key)
    places = [F.shiftrightunsigned(spot, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(4)]
    one, *more = [F.call_function("shiftleft", F.lit(1).cast("long"), place) for place in places]
    for bit in more:
        one = one.bitwiseOR(bit)
    return one


def key_filter(keys: DataFrame, key: str, words: int = WORDS) -> DataFrame:
    """The filter of a column's values: ``word`` and its ``bits``. ``words`` is a power of two, 2 ** 24 at most."""
    marked = keys.select(_word(F.col(key), words).alias("word"), _bits(F.col(key)).alias("bits"))
    return marked.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def possibly_in(rows: DataFrame, key: str, filter_: DataFrame, words: int = WORDS) -> DataFrame:
    """Rows whose key may be in the filter, which is built with as many ``words``."""
    probe = rows.withColumns({"probe_word": _word(F.col(key), words), "probe_bits": _bits(F.col(key))})
    words_ = F.broadcast(filter_.toDF("filter_word", "filter_bits"))
    all_set = F.col("probe_bits").bitwiseAND(F.col("filter_bits")) == F.col("probe_bits")
    met = probe.join(words_, (F.col("probe_word") == F.col("filter_word")) & all_set)
    return met.select(*[F.col(quoted(c)) for c in rows.columns])
