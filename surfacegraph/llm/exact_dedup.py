"""Exact deduplication with a two-pass Bloom filter, in DataFrame operations only.

Pass one hashes each row's normalised text into one 64-bit word of a blocked
Bloom filter and marks, per word, the bits that at least two rows set. Pass
two tests each row against those bits: a row whose bits are not all marked
shares its text with no other row and goes straight to the result; only the
possibly repeated rows shuffle by their text's hash. All of this works on a
narrow table of hashes, lengths and ids; texts stay where they are.

The filter has a word for about four rows, however many rows there are. Up to
``max_words`` words (16 bytes each) it is broadcast; a larger one stays
partitioned by word, and the narrow rows meet it by a shuffle join.

A group of copies that holds a third of all rows is aggregated before the
shuffle to one candidate a task; the join back to its rows is by a broadcast
of the few hot groups' winners (:func:`hot.join_groups`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .hot import join_groups
from .workspace import fresh, written

#: Characters that do not count when texts are compared.
SPACES = r"[\x20\x09-\x0D]"


def repeated_bits(hashes: DataFrame, key: str, words: int) -> DataFrame:
    """The filter: (word, bits), where ``bits`` were set by two rows or more.

    ``words`` bounds the rows of the result.
    """
    h = F.col(key)
    cells = hashes.select(
        F.pmod(h, F.lit(words)).alias("word"),
        F.explode(F.array(*_bits(h))).alias("bit"),
    )
    return (
        cells.groupBy("word", "bit")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    )


def _bits(h: Column) -> list[Column]:
    """Three different bit numbers of a row's word: a row never sets one twice."""
    first = F.shiftrightunsigned(h, 58).cast("int")
    step = F.shiftrightunsigned(h, 53).bitwiseAND(F.lit(31)).cast("int")
    second = (first + F.lit(1) + step) % 64
    third = (first + F.lit(33) + F.shiftrightunsigned(h, 48).bitwiseAND(F.lit(15)).cast("int")) % 64
    third = F.when(third == second, (third + 16) % 64).otherwise(third)
    return [first, second, third]


def split_repeated(rows: DataFrame, key: str, count: int, max_words: int) -> tuple[DataFrame, DataFrame]:
    """(possibly repeated, certainly single) rows by the 64-bit hash ``key``.

    ``max_words`` bounds what is broadcast, not the filter.
    """
    words = 1 << 10
    while words * 4 < count:
        words *= 2
    (word, bits) = fresh(rows.columns, "filter_word", "filter_bits")
    marked = repeated_bits(rows, key, words).select(F.col("word").alias(word), F.col("bits").alias(bits))
    marked = written(marked, "filter-words")
    if words <= max_words:
        marked = F.broadcast(marked)
    mask = None
    for b in _bits(F.col(key)):
        one = F.call_function("shiftleft", F.lit(1).cast("long"), b)
        mask = one if mask is None else mask.bitwiseOR(one)
    tested = rows.join(marked, F.pmod(F.col(key), F.lit(words)) == F.col(word), "left")
    hit = F.coalesce(F.col(bits).bitwiseAND(mask) == mask, F.lit(False))
    return tested.where(hit).select(rows.columns), tested.where(~hit).select(rows.columns)


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.sha2(F.regexp_replace(text, SPACES, ""), 256).alias("text_sha256"),
        F.length(text).alias("points"),
        F.xxhash64(F.col(id_col).cast("long"), text).alias("node"),
        F.monotonically_increasing_id().alias("row"),
    )
    return written(narrow.withColumn("key", F.xxhash64("text_sha256")), "exact-dedup")


def _winners(maybe: DataFrame) -> DataFrame:
    """(text_sha256, keep_id, keep_points, keep_row, group_size) of the possibly repeated texts."""
    best = F.max(F.struct("points", (~F.col("doc_id").isNull()).alias("has_id"), F.bitwise_not("doc_id").alias("low"), F.bitwise_not("row").alias("first")))
    winners = maybe.groupBy("text_sha256").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    return winners.select(
        "text_sha256", F.bitwise_not("best.low").alias("keep_id"), F.col("best.points").alias("keep_points"), F.bitwise_not("best.first").alias("keep_row"), "group_size"
    )


def mark_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_words: int = 1 << 21,
) -> DataFrame:
    """One row per row of ``docs``: which row of its group of equal texts stays.

    Columns: the id (as ``doc_id``), ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256`` and ``row``, a number that is different in each row.

    Texts are equal when identical after deleting white space. Of equal texts
    the row with the most code points in the original text stays, then the
    smallest id; a null id comes after all others, and of rows that agree in
    id and length one stays. A null text counts as empty, so null, empty and
    blank texts form one group. An empty table gives an empty result. Columns
    other than the two named are not read.
    """
    narrow = _narrow(docs, id_col, text_col)
    maybe, single = split_repeated(narrow, "key", narrow.count(), max_words)
    grouped = join_groups(maybe, _winners(maybe), ["text_sha256"], "group_size").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "row"
    )
    alone = single.select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "row"
    )
    return alone.unionByName(grouped)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_words: int = 1 << 21) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Semantics as in :func:`mark_copies`.

    The decision is made on the narrow table. Then rows pass straight through,
    but for those that a filter of the dropped rows finds: only these shuffle
    with their texts, to be told apart exactly by id, hash and length. Rows
    that agree with a row that stays in all three are reduced to one.
    """
    narrow = _narrow(docs, id_col, text_col)
    maybe, _ = split_repeated(narrow, "key", narrow.count(), max_words)
    placed = join_groups(maybe, _winners(maybe).where("group_size > 1"), ["text_sha256"], "group_size")
    same = (F.col("points") == F.col("keep_points")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    placed = written(placed.withColumn("same", same).where(~F.col("same") | (F.col("row") != F.col("keep_row"))), "dropped-rows")

    sha, points, d_id, d_sha, d_points = fresh(docs.columns, "dedup_sha", "dedup_points", "dropped_id", "dropped_sha", "dropped_points")
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = [F.col("doc_id").alias(d_id), F.col("text_sha256").alias(d_sha), F.col("points").alias(d_points)]
    full = [F.sha2(F.regexp_replace(text, SPACES, ""), 256).alias(sha), F.length(text).alias(points)]
    is_it = F.col(id_col).cast("long").eqNullSafe(F.col(d_id)) & (F.col(sha) == F.col(d_sha)) & (F.col(points) == F.col(d_points))
    node = F.xxhash64(F.col(id_col).cast("long"), text)
    some, clean = bloom.split(docs, node, placed.select("node"), placed.count())
    some = some.select("*", *full)
    lost = placed.where("not same").select(*named).distinct()
    kept = some.join(lost, is_it, "left_anti")
    again = placed.where("same").select(*named).distinct()
    if again.limit(1).isEmpty():
        return clean.unionByName(kept.select(docs.columns))
    twice = kept.join(again, is_it, "left_semi").dropDuplicates([id_col, sha, points])
    once = kept.join(again, is_it, "left_anti")
    return clean.unionByName(once.select(docs.columns)).unionByName(twice.select(docs.columns))
