"""Mixing sources to target weights by entropy balancing.

Documents get rates: the rates nearest to one (in relative entropy) under
which each source contributes its target number of words. The dual problem is
convex with one multiplier a source, and its solution tilts the documents
exponentially: rate = exp(multiplier * size / mean size), at most ``cap``.
Newton iterations find the multipliers; each is one distributed aggregation
over the histogram of (source, size), safeguarded by a bracket. Sums are of
integers (rates in units of 2**-20), so reruns agree to the last copy.

Sources, targets and multipliers stay in tables, however many there are: the
driver sees one row a step. Rates are rounded into whole copies: bin by bin of
equal source and size, with the rounding error carried on to the next smaller
size, so a source's total ends within about its smallest size of the target.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import fresh, written

UNIT = 1 << 20
#: Fewest documents of one bin that a task ranks together, about; of larger bins the square root.
RANKED = 64
#: Newton steps at most; a bracket halves where Newton's step leaves it.
ROUNDS = 60


def word_count(text: Column) -> Column:
    """Runs of characters that are not ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_hash(doc_id: Column, text: Column) -> Column:
    """A non-negative hash by which documents of one bin are ordered: of the id and the text."""
    return F.shiftrightunsigned(F.xxhash64(doc_id.cast("long"), text, F.lit(17)), 1)


def _numbered(df: DataFrame, order: Column, name: str) -> DataFrame:
    """``df`` with ``name``: each row's place in the order, from 0. No task sees all rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at, part, base = fresh(df.columns, "at", "part", "base")
    placed = written(df.repartitionByRange(n, order).sortWithinPartitions(order).withColumn(at, F.monotonically_increasing_id()), "numbered")
    part_of = F.shiftright(F.col(at), 33).cast("int")
    rows = placed.groupBy(part_of.alias(part)).count().orderBy(part).collect()  # a row a task
    bases, total = [], 0
    for r in rows:
        bases.append((r[part], total))
        total += r["count"]
    bases = df.sparkSession.createDataFrame(bases, f"{part} int, {base} long")
    return placed.withColumn(part, part_of).join(F.broadcast(bases), part).withColumn(name, F.col(base) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at, part, base)


def targets(sources: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """``sources(source, words, docs)`` with ``src`` (its number) and ``target``, the words it is to contribute.

    Sources in code point order, null last, weigh ``weights``, repeating, and
    share ``share`` of all words. A target stops at ``cap`` times its source's
    words, and the excess is shared again by weight until none is above.
    """
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    table = written(_numbered(sources, F.asc_nulls_last("source"), "src").withColumn("weight", weigh), "sources")
    most = F.lit(float(cap)) * F.col("words")
    level = 0.0  # words a unit of weight; it only rises, as more sources stop at their cap
    while True:
        above = F.col("weight") * F.lit(level) > most
        got = table.agg(
            F.sum("words").alias("words"),
            F.sum(F.when(above, F.col("words"))).alias("stopped"),
            F.sum(F.when(~above, F.col("weight").cast("decimal(30,9)"))).alias("weight"),
        ).first()
        if not got["weight"]:
            break
        new = (share * int(got["words"]) - cap * int(got["stopped"] or 0)) / float(got["weight"])
        if new <= level:
            break
        level = new
    return table.withColumn("target", F.least(F.col("weight") * F.lit(level), most)).drop("weight")


def rate_of(tilt: Column, cap: float) -> Column:
    """exp(tilt), at most ``cap``, in units of 2**-20."""
    return F.floor(F.least(F.lit(float(cap)), F.exp(F.least(tilt, F.lit(50.0)))) * UNIT)


def multipliers(hist: DataFrame, table: DataFrame, cap: float, rounds: int = ROUNDS) -> DataFrame:
    """(src, lam): the dual solution.

    ``hist(src, size long, n long, unit double)``: unit is size / mean size;
    ``table(src, words, target)``. A source whose target is all that ``cap``
    allows, or nothing, needs no step.
    """
    full = F.col("target") >= F.col("words") * F.lit(cap * (1 - 1e-12))
    inf = F.lit(float("inf"))
    state = table.where("words > 0").select(
        "src",
        "target",
        F.when(full, 1e6).when(F.col("target") <= 0, -1e6).otherwise(F.log(F.greatest(F.col("target"), F.lit(1e-9)) / F.col("words"))).alias("lam"),
        (-inf).alias("lo"),
        inf.alias("hi"),
        (~full & (F.col("target") > 0)).alias("todo"),
    )
    tilt = F.col("lam") * F.col("unit")
    rate, words = rate_of(tilt, cap), (F.col("n") * F.col("size")).cast("decimal(30,0)")
    slope = F.floor(F.when(tilt < math.log(cap), rate.cast("double") * F.col("unit")).otherwise(0.0))
    off = F.col("f") / UNIT - F.col("target")
    done = (F.abs(off) <= 1e-6 * F.col("target")) | (F.col("hi") - F.col("lo") < 1e-12)
    lo, hi = F.when(off > 0, F.col("lo")).otherwise(F.col("lam")), F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
    newton = F.col("lam") - off / (F.col("g") / UNIT)
    half = (
        F.when(F.col("lo2") == -inf, F.least(F.lit(-1.0), 2 * F.col("hi2")) - 1)
        .when(F.col("hi2") == inf, F.greatest(F.lit(1.0), 2 * F.col("lo2")) + 1)
        .otherwise((F.col("lo2") + F.col("hi2")) / 2)
    )
    inside = (F.col("g") > 0) & (F.col("newton") > F.col("lo2")) & (F.col("newton") < F.col("hi2"))
    for _ in range(rounds):
        state = written(state, "multipliers")
        if state.where("todo").limit(1).isEmpty():
            break
        sums = hist.join(state.where("todo").select("src", "lam"), "src").groupBy("src").agg(
            F.sum(words * rate.cast("decimal(8,0)")).cast("double").alias("f"), F.sum(words * slope.cast("decimal(12,0)")).cast("double").alias("g")
        )
        found = state.join(sums, "src", "left").withColumns({"done": ~F.col("todo") | F.coalesce(done, F.lit(True)), "lo2": lo, "hi2": hi, "newton": newton})
        step = F.when(inside, F.col("newton")).otherwise(half)
        keep = F.col("done")
        state = found.select(
            "src",
            "target",
            F.when(keep, F.col("lam")).otherwise(F.round(step, 12)).alias("lam"),
            F.when(keep, F.col("lo")).otherwise(F.col("lo2")).alias("lo"),
            F.when(keep, F.col("hi")).otherwise(F.col("hi2")).alias("hi"),
            (~keep).alias("todo"),
        )
    return state.select("src", "lam")


def _round(frame: pd.DataFrame, cap: float) -> pd.DataFrame:
    """Whole copies for each bin of one source, largest sizes first, carrying the error in words."""
    frame = frame.sort_values("size", ascending=False, ignore_index=True)
    copies, carry = [], 0.0
    for size, n, rate in zip(frame["size"], frame["n"], frame["rate"], strict=True):
        exact = n * rate / UNIT * size + carry
        k = int(min(cap * n, max(0, math.floor(exact / size + 0.5))))
        carry = exact - k * size
        copies.append(k)
    # what small bins could not take up goes back to the bins that still can
    for i, (size, n) in enumerate(zip(frame["size"], frame["n"], strict=True)):
        k = max(-copies[i], min(int(cap * n) - copies[i], int(carry / size)))
        copies[i] += k
        carry -= k * size
    return frame.assign(copies=np.array(copies, np.int64))[["src", "size", "n", "copies"]]


def _plan(docs: DataFrame, weights, share, cap, id_col, text_col, source_col) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sized rows, source table, plan).

    The plan has a row for each source and size: ``each`` copies of every
    document, one more for those whose hash is below ``upto``, and one more
    for ``ties`` of the ``tied`` documents whose hash is ``upto``.
    """
    text = F.col(text_col)
    sized = written(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), order_hash(F.col(id_col), text).alias("u"), F.monotonically_increasing_id().alias("row")),
        "sized",
    )
    bins = written(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "size-bins")
    sources = bins.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.sum("n").alias("docs"))
    table = targets(sources, weights, share, cap)
    table = written(table.withColumnsRenamed({"source": "name", "words": "source_size"}).withColumn("mean", F.col("source_size") / F.col("docs")).drop("docs"), "source-targets")
    hist = bins.where("size > 0").join(table, F.col("source").eqNullSafe(F.col("name")))
    hist = written(hist.select("src", "size", "n", (F.col("size") / F.col("mean")).alias("unit")), "numbered-bins")
    lam = multipliers(hist, table.select("src", F.col("source_size").alias("words"), "target"), cap)
    rated = hist.join(lam, "src").select("src", "size", "n", rate_of(F.col("lam") * F.col("unit"), cap).alias("rate"))
    copies = rated.groupBy("src").applyInPandas(lambda f: _round(f, cap), "src long, size long, n long, copies long")  # a row a size
    each = F.floor(F.col("copies") / F.col("n"))
    slices = F.greatest(F.lit(1), F.least(F.ceil(F.col("n") / RANKED), F.ceil(F.sqrt("n"))))
    copies = written(copies.select("src", "size", "n", each.alias("each"), (F.col("copies") - each * F.col("n")).alias("extra"), slices.alias("slices")), "planned-bins")

    # the hash up to which a bin's documents get the extra copy: equal hashes
    # are counted first, bins are cut into slices by hash, counts tell the
    # slice, and only that slice is ranked
    some = copies.where("extra > 0")
    named = sized.where("size > 0").join(table.select("src", "name"), F.col("source").eqNullSafe(F.col("name"))).select("src", "size", "u")
    placed = named.groupBy("src", "size", "u").agg(F.count(F.lit(1)).alias("c")).join(some, ["src", "size"])
    placed = placed.withColumn("slice", F.least(F.col("slices") - 1, F.floor(F.col("u") / F.lit(2.0**63) * F.col("slices"))))
    placed = written(placed.select("src", "size", "u", "c", "slice", "extra"), "placed")
    counts = placed.groupBy("src", "size", "slice").agg(F.sum("c").alias("m"), F.first("extra").alias("extra"))
    before = F.sum("m").over(Window.partitionBy("src", "size").orderBy("slice")) - F.col("m")
    cut = counts.withColumn("rest", F.col("extra") - before).where("rest > 0 and rest <= m").select("src", "size", "slice", "rest")
    upto = F.sum("c").over(Window.partitionBy("src", "size", "slice").orderBy("u"))
    at = placed.drop("extra").join(cut, ["src", "size", "slice"]).withColumn("end", upto).where("rest <= end and rest > end - c")
    at = at.select("src", "size", F.col("u").alias("upto"), (F.col("rest") - F.col("end") + F.col("c")).alias("ties"), F.col("c").alias("tied"))
    plan = copies.join(at, ["src", "size"], "left").select("src", "size", "each", F.coalesce("upto", F.lit(-1).cast("long")).alias("upto"), F.coalesce("ties", F.lit(0)).alias("ties"), F.coalesce("tied", F.lit(0)).alias("tied"))
    return sized, table, written(plan, "mix-plan")


def _extra(u: Column, upto: Column, ties: Column, tied: Column) -> Column:
    """1 for a row below the hash, or at it where all its rows get the copy."""
    return F.when((u < upto) | ((u == upto) & (ties == tied)), 1).otherwise(0)


def _ranked(rows: DataFrame, by: list[str], row: str, rank: str) -> DataFrame:
    """``rank``: a row's place among those that agree in ``by``, from 1, by ``row`` (task and place in the task)."""
    part, many, base = fresh([*rows.columns, rank], "part", "many", "base")
    split = rows.withColumn(part, F.shiftright(F.col(row), 33))
    held = split.groupBy(*by, part).agg(F.count(F.lit(1)).alias(many))
    held = held.select(*by, part, (F.sum(many).over(Window.partitionBy(*by).orderBy(part)) - F.col(many)).alias(base))
    inner = F.row_number().over(Window.partitionBy(*by, part).orderBy(row))
    return split.withColumn(rank, inner).join(held, [*by, part]).withColumn(rank, F.col(rank) + F.col(base)).drop(part, base)


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.0,
    cap: float = 3.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, copies, row`` for every row of ``docs``.

    ``taken`` is ``copies`` times ``size``; ``row`` numbers the rows. A null
    text has size 0; a null source is a source of its own, ordered last. Rows
    without words are taken 0 times. Each row decides for itself, also where
    ids are null or repeated; of rows that agree in source, id and text so
    many get the extra copy as the target needs. An empty table gives an empty
    result. Only the three named columns are read.

    A bin of documents of equal source and size, however large, is ranked in
    hash slices of about the square root of its rows.
    """
    sized, table, plan = _plan(docs, weights, share, cap, id_col, text_col, source_col)
    edge = plan.where("ties < tied").select("src", "size", "upto", "ties")
    edges = not edge.limit(1).isEmpty()
    plan = plan.withColumnsRenamed({"src": "p_src", "size": "p_size"})
    rows = sized.join(table, F.col("source").eqNullSafe(F.col("name")))
    joined = rows.join(plan, (F.col("src") == F.col("p_src")) & (F.col("size") == F.col("p_size")), "left")
    extra = _extra(F.col("u"), F.col("upto"), F.col("ties"), F.col("tied"))
    if edges:  # rows that agree in all that decides, of which some get a copy
        at = sized.where("size > 0").join(table.select("src", "name"), F.col("source").eqNullSafe(F.col("name"))).select("src", "size", "u", "row")
        at = written(at.join(edge, ["src", "size"]).where("u = upto").select("src", "size", "row", "ties"), "tied-rows")
        lucky = _ranked(at, ["src", "size"], "row", "rank").where("rank <= ties").select(F.col("row").alias("l_row"))
        joined = joined.join(lucky, F.col("row") == F.col("l_row"), "left")
        extra = F.when(F.col("l_row").isNotNull(), 1).otherwise(extra)
    copies = F.coalesce(F.col("each") + extra, F.lit(0)).cast("int")
    return joined.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "row")


#: Rows of a plan (sources times sizes that occur) up to which it is broadcast.
BROADCAST_ROWS = 400_000


def mixed(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.0,
    cap: float = 3.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it, with their columns.

    Rows without words are dropped. A row decides for itself by source, size
    and hash, so texts do not shuffle: the plan is broadcast if it has at most
    ``BROADCAST_ROWS`` rows, and joined otherwise. Only rows that agree with
    others in source, id and text, of which some get a copy more, are written
    and numbered. Null and repeated ids as in :func:`mix`.
    """
    _, table, plan = _plan(docs, weights, share, cap, id_col, text_col, source_col)
    names = ("mix_source", "mix_size", "mix_each", "mix_upto", "mix_ties", "mix_tied", "mix_words", "mix_hash", "mix_copies", "mix_row", "mix_rank")
    k_source, k_size, k_each, k_upto, k_ties, k_tied, k_words, k_hash, k_copies, k_row, k_rank = fresh(docs.columns, *names)
    plan = plan.join(table.select("src", "name"), "src").select(
        F.col("name").alias(k_source), F.col("size").alias(k_size), F.col("each").alias(k_each), F.col("upto").alias(k_upto), F.col("ties").alias(k_ties), F.col("tied").alias(k_tied)
    )
    plan = written(plan.where((F.col(k_each) > 0) | (F.col(k_upto) >= 0)), "named-plan")
    edges = not plan.where(F.col(k_ties) < F.col(k_tied)).limit(1).isEmpty()
    if plan.count() <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    sized = docs.withColumn(k_words, word_count(F.col(text_col))).withColumn(k_hash, order_hash(F.col(id_col), F.col(text_col)))
    joined = sized.join(plan, F.col(source_col).eqNullSafe(F.col(k_source)) & (F.col(k_words) == F.col(k_size)))

    def repeated(rows: DataFrame, extra: Column) -> DataFrame:
        copies = F.array_repeat(F.lit(0), (F.col(k_each) + extra).cast("int"))
        return rows.withColumn(k_copies, F.explode(copies)).select(docs.columns)

    extra = _extra(F.col(k_hash), F.col(k_upto), F.col(k_ties), F.col(k_tied))
    if not edges:
        return repeated(joined, extra)
    tie = (F.col(k_hash) == F.col(k_upto)) & (F.col(k_ties) < F.col(k_tied))
    some = written(joined.where(tie).withColumn(k_row, F.monotonically_increasing_id()), "tied-documents")
    # the bin's source may be null, which its hash stands in for
    some = _ranked(some.withColumn(k_hash, F.xxhash64(F.col(k_source), F.col(k_hash))), [k_hash, k_size], k_row, k_rank)
    return repeated(joined.where(~tie), extra).unionByName(repeated(some, F.when(F.col(k_rank) <= F.col(k_ties), 1).otherwise(0)))
