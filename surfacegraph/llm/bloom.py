"""Membership in a set of 64-bit keys, by a broadcast filter of bounded size.

Joins that keep few rows of a wide table shuffle only the rows that may match:
the others are told apart before the shuffle. DataFrame operations only. The
filter has at most ``max_words`` rows, whatever the input; over more keys it
lets more rows through, and results stay the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import fresh


def _mask(h: Column) -> Column:
    mask = None
    for shift in (58, 52, 46):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int"))
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return mask


def split(rows: DataFrame, key: Column, keys: DataFrame, count: int, max_words: int = 1 << 21) -> tuple[DataFrame, DataFrame]:
    """(rows that may be in ``keys``, rows that are not). ``keys`` has one long column."""
    words = 1 << 10
    while words < max_words and words * 4 < count:
        words *= 2
    word, bits = fresh(rows.columns, "filter_word", "filter_bits")
    k = F.col(keys.columns[0])
    marked = keys.groupBy(F.pmod(k, F.lit(words)).alias(word)).agg(F.bit_or(_mask(k)).alias(bits))
    tested = rows.join(F.broadcast(marked), F.pmod(key, F.lit(words)) == F.col(word), "left")
    hit = F.coalesce(F.col(bits).bitwiseAND(_mask(key)) == _mask(key), F.lit(False))
    return tested.where(hit).select(rows.columns), tested.where(~hit).select(rows.columns)
