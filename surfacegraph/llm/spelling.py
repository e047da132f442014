"""Words that differ by one edit, grouped under their most frequent spelling.

Pairs within one inserted, deleted or replaced character are found by an even
partition and the pigeonhole principle: a word is cut into two segments, half
its length each, and one edit leaves one of them as it is. Each word is indexed
under both segments; words of equal length, and words one longer, probe with
the substrings in the same place, the second moved by the difference of the
lengths. What meets is deduplicated, and one edit verified.

A frequent segment would bring very many words together. What a meeting says,
though, is that two words agree outside an open part that holds the edit, so a
bucket of too many words is split the same way: its open part is halved, and
one half agrees too. At the end the open part is one character, or none where
the probing word is longer, and buckets hold words that are near indeed. So no
bucket's size is capped, none brings out all its pairs, and no pair is lost.

Words and counts stay in tables. Defined results: a null text has no words, a
null id reads as the empty string; repeated rows count each time; ties between
near words go to the smallest in code-point order; very long words are words
like others; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hot import join_groups
from .workspace import fresh, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed value: the characters of words.
LETTERS = "A-Za-z\\u00C0-\\u00FF"

#: A bucket in which an indexed and a probing word would meet more often than this is split.
MOST_MEETINGS = 4096


def count_words(
    docs: DataFrame,
    least: int = 6,
    n: int = 5,
    text: str = "text",
    spelled: Callable[[Column], Column] | None = None,
    shrinks: int = 0,
) -> DataFrame:
    """(word, n): words of at least ``least`` characters that occur ``n`` times or more in all texts.

    Words are maximal runs of Latin letters, A to Z lower-cased. ``spelled``
    maps a run to the word it counts as (it may use other columns), and may
    take away ``shrinks`` characters at most.
    """
    run = fresh(docs.columns, "run")[0]
    # a run that could not reach the least length is passed over by the pattern
    found = F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    runs = docs.where(F.col(text).isNotNull()).withColumn(run, F.explode(found)).withColumn(run, F.translate(run, UPPER, LOWER))
    words = runs.select((spelled(F.col(run)) if spelled else F.col(run)).alias("word"))
    if shrinks:
        words = words.where(F.char_length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= n)


def _around(word: Column, start: Column, end: Column) -> Column:
    """The word without its characters from ``start`` to ``end``; no letter equals the mark between."""
    return F.concat(F.substring(word, F.lit(1), start), F.lit("|"), F.substring(word, end + 1, F.char_length(word)))


def _split(rows: DataFrame, longer: int, closed: bool) -> DataFrame:
    """A row for each half of the rows' open part, keyed by what lies outside.

    ``longer``: characters that the word has more in its open part than the
    bounds say. A single open character stays; where ``closed``, its halves are
    the empty parts before and behind it.
    """
    start, end = F.col("start"), F.col("end")
    middle = F.expr("(start + end) div 2").cast("int")

    def part(a: Column, z: Column) -> Column:
        return F.struct(a.alias("start"), z.alias("end"))

    single = F.array(part(start, start), part(end, end)) if closed else F.array(part(start, end))
    halves = F.when(end - start > 1, F.array(part(start, middle), part(middle, end))).otherwise(single)
    dealt = rows.select("word", "size", F.explode(F.array_distinct(halves)).alias("part")).select("word", "size", "part.*")
    return dealt.withColumn("key", _around(F.col("word"), F.col("start"), F.col("end") + longer))


#: What names a bucket: the length of the indexed words, their open part, and what lies outside.
BUCKET = ["size", "start", "end", "key"]


def _equally_long(words: DataFrame, most: int) -> list[DataFrame]:
    """Tables of pairs (a, b) of one length. Each pair has its difference in one open part of a level, so none repeats."""
    rows, found = written(_split(words, 0, closed=False), "spelling-keys"), []
    while True:
        many = rows.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("indexed")).where("indexed > 1")
        # rows of a bucket that holds very many stay where they are
        rows = written(join_groups(rows, many, BUCKET, "indexed"), "spelling-keys")
        # words that differ in one given place only are as many as there are letters, and near indeed
        wide = (F.col("indexed") * F.col("indexed") > most) & (F.col("end") - F.col("start") > 1)
        a, b = (rows.where(~wide).select(*BUCKET, F.col("word").alias(side)) for side in "ab")
        found.append(a.join(b, BUCKET).where((F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1)).select("a", "b"))
        wider = rows.where(wide)
        if wider.limit(1).isEmpty():
            return found
        rows = written(_split(wider, 0, closed=False), "spelling-keys")


def _one_longer(words: DataFrame, most: int) -> list[DataFrame]:
    """Tables of pairs (a, b), b the longer one. A pair may repeat, where the inserted character equals its neighbour."""
    probes = words.withColumn("size", F.col("size") - 1).withColumn("end", F.col("end") - 1).where("size >= 0")
    index, more = written(_split(words, 0, closed=True), "spelling-keys"), written(_split(probes, 1, closed=True), "spelling-keys")
    found = []
    while True:
        many = index.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("indexed"))
        many = written(many.join(more.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("probing")), BUCKET), "spelling-buckets")
        index = written(join_groups(index, many, BUCKET, "indexed"), "spelling-keys")
        more = written(join_groups(more, many, BUCKET, "probing"), "spelling-keys")
        # with an empty open part one word is indexed, and all that probe it are near
        wide = (F.col("indexed") * F.col("probing") > most) & (F.col("end") > F.col("start"))
        a, b = index.where(~wide).select(*BUCKET, F.col("word").alias("a")), more.where(~wide).select(*BUCKET, F.col("word").alias("b"))
        found.append(a.join(b, BUCKET).where(F.levenshtein("a", "b", 1) == 1).select("a", "b"))
        wider = index.where(wide)
        if wider.limit(1).isEmpty():
            return found
        index = written(_split(wider, 0, closed=True), "spelling-keys")
        more = written(_split(more.where(wide), 1, closed=True), "spelling-keys")


def near_pairs(words: DataFrame, most: int = MOST_MEETINGS) -> DataFrame:
    """(a, b): pairs of different words of ``words(word)`` one edit apart, each once; b is the longer if one is."""
    size = F.char_length("word")
    whole = words.select("word", size.alias("size"), F.lit(0).alias("start"), size.alias("end"))
    same, longer = _equally_long(whole, most), _one_longer(whole, most)
    pairs, *others = [*same, *longer]
    for other in others:
        pairs = pairs.unionByName(other)
    return pairs.distinct()


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words(word, n)``, whose words differ.

    ``form``: the near word that occurs most, if ``ratio`` times as often as the
    word or more, else null; ``root``: where the forms lead, from a word to its
    form and on; ``n_near``: how many words are near.
    """
    words = written(words, "spelling-words")
    pairs = written(near_pairs(words.select("word")), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).union(pairs.select("b", "a"))
    counted = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    facts = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    told = words.join(facts, "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    told = told.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    told = written(told, "spelling-forms")
    roots = _roots(told.where("form is not null").select("word", F.col("form").alias("root")))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, next): each round follows twice as many steps. Counts grow along the steps, so they end."""
    while True:
        # a form has at most as many words as it has near ones; a root may have more, and they meet its one row
        further = forms.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = forms.join(further, "root", "left")
        step = written(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        forms = step.select("word", "root")
        if step.where("moved").limit(1).isEmpty():
            return forms
