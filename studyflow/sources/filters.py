"""Bloom filters of ids as tables: built, stored and asked with DataFrame functions.

An id sets five bits of one 64-bit word; a filter is the words that have a bit set. Words are addressed within a bucket by
WORDS places, so a filter of n ids has at most min(n, WORDS) rows however many ids come, and memory is never asked
for: only the words of the asked ids are joined. At four ids a word about one id in a hundred that is not there seems to be;
with fewer ids fewer do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 20
BITS = 5


def id_word(key: str) -> Column:
    """Place of the word of an id."""
    return F.pmod(F.xxhash64(F.lit("word"), key), F.lit(WORDS)).cast("int")


def id_mask(key: str) -> Column:
    """The bits of an id within its word."""
    mixed = f"xxhash64('mask', `{key}`)"
    bits = [f"shiftleft(1L, cast(shiftright({mixed}, {6 * k}) & 63 as int))" for k in range(BITS)]
    return F.expr(" | ".join(bits))


def filter_words(ids: DataFrame, key: str) -> DataFrame:
    """Words of the filters of ``ids`` by ``batch`` and ``bucket``."""
    return (
        ids.where(F.col(key).isNotNull())
        .groupBy("batch", "bucket", id_word(key).alias("word_at"))
        .agg(F.bit_or(id_mask(key)).alias("word"))
        .select("word_at", "word", "batch", "bucket")
    )
