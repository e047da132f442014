"""Near-duplicate documents: SimHash fingerprints, covering LSH, components.

Fingerprints are 64 bits. Covering locality-sensitive hashing (Pagh) takes a
random map of the 64 positions to the nonzero vectors of r + 1 bits; the mask
of each nonzero vector v selects the positions whose vector has an odd overlap
with v. Two fingerprints that differ in at most r bits agree on at least one
of the 2**(r+1) - 1 masks, always.

Links are never expanded into all pairs of a bucket. First, every member is
compared with the smallest fingerprint of its bucket, and the links found give
components. Then only buckets that still hold several components are compared
further, and there only pairs of different components: a small bucket in one
array, a large one in blocks of its dominant component, each against the few
rows outside it. Every link between different components is thereby tested,
so the components are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom, text_tokens
from .components import components
from .hot import join_groups
from .workspace import bound_batches, by_bytes, fresh, written

BITS = 64
#: Members of a bucket that one task compares in one array.
BLOCK = 1024
#: Translation that lower-cases A-Z in UTF-8.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash over the text's word shingles, repeats included; 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: len(words) - shingle + 1]
    ends = ends[shingle - 1 :]
    h = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65536):
        total += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp long) for every row, from its whole text. No shuffle."""

    bound_batches(docs.sparkSession)

    def run(batches):
        text_tokens.release()
        for b in by_bytes(batches, 1):
            fp = np.fromiter((fingerprint(t, shingle) for t in b.column("t").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, "doc_id long, fp long")


def masks(radius: int, seed: int = 1, bits: int = BITS) -> list[int]:
    """The 2**(radius+1) - 1 covering masks of so many bits, as signed 64-bit integers."""
    rng = np.random.default_rng(seed)
    # each nonzero vector is used about equally often, so masks are balanced
    vectors = [1 + int(i) % (2 ** (radius + 1) - 1) for i in rng.permutation(bits)]
    out = []
    for v in range(1, 2 ** (radius + 1)):
        m = sum(1 << i for i, a in enumerate(vectors) if bin(a & v).count("1") % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def link_components(nodes: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """(fp, component) of different fingerprints ``nodes(fp long)``.

    ``component`` is one fingerprint of each group joined by links of at most
    ``radius`` differing bits. Fingerprints without a link may be missing.
    """
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks(radius)])).alias("t", "key"))
    buckets = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("rep")).where("n > 1")
    members = written(join_groups(keyed, buckets, ["t", "key"], "n"), "bucket-members")

    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("rep"))) <= radius
    stars = members.where(near).select(F.col("fp").alias("a"), F.col("rep").alias("b")).distinct()
    first = written(components(stars), "star-components")

    named = members.join(first, members["fp"] == first["node"], "left").select(
        "t", "key", "n", "fp", F.coalesce("component", "fp").alias("comp")
    )
    named = written(named, "named-members")
    sizes = named.groupBy("t", "key", "comp").agg(F.count(F.lit(1)).alias("m"))
    open_ = sizes.groupBy("t", "key").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("many")).where("comps > 1")
    todo = join_groups(named, open_.select("t", "key", F.col("top.comp").alias("main"), F.col("top.m").alias("mains"), "many"), ["t", "key"], "many")

    # where a row goes in its bucket: rows of the dominant component to one
    # block, the others to every block of it and to each pair of their own
    outside = F.col("n") - F.col("mains")
    h = F.xxhash64("fp", F.lit(3))
    main_blocks = F.ceil(F.greatest(F.lit(1), F.col("mains")) / block).cast("int")
    own_blocks = F.ceil(outside / block).cast("int")
    own = F.pmod(h, own_blocks).cast("int")
    small = F.col("n") <= 2 * block
    to = (
        F.when(small, F.array(F.lit("all")))
        .when(F.col("comp") == F.col("main"), F.transform(F.sequence(F.lit(0), own_blocks - 1), lambda j: F.concat_ws(":", F.pmod(h, main_blocks), j)))
        .otherwise(
            F.concat(
                F.transform(F.sequence(F.lit(0), main_blocks - 1), lambda i: F.concat_ws(":", i, own)),
                F.transform(F.sequence(F.lit(0), own_blocks - 1), lambda j: F.concat_ws("|", F.least(j, own), F.greatest(j, own))),
            )
        )
    )
    cells = todo.select("t", "key", F.explode(to).alias("cell"), "fp", "comp")
    grouped = cells.groupBy("t", "key", "cell").agg(F.collect_list(F.struct("fp", "comp")).alias("rows"))
    more = grouped.select(F.col("rows.fp").alias("fp"), F.col("rows.comp").alias("comp")).mapInArrow(_cross_links(radius), "a long, b long")
    links = stars.unionByName(more).distinct()
    return components(links).select(F.col("node").alias("fp"), "component")


def _cross_links(radius: int):
    def run(batches):
        for batch in batches:
            a, b = [], []
            for fps, comps in zip(batch.column("fp"), batch.column("comp"), strict=True):
                for x, y in cross_links(np.array(fps.as_py(), np.int64), np.array(comps.as_py(), np.int64), radius):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def cross_links(fp: np.ndarray, comp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """One link for each pair of components that rows of this cell join."""
    order = np.argsort(comp, kind="stable")
    fp, comp = fp[order].view(np.uint64), comp[order]
    starts = np.flatnonzero(np.r_[True, comp[1:] != comp[:-1]])
    ends = np.r_[starts[1:], len(comp)]
    # the largest component is never the row side, so the work is (rows outside it) x (rows)
    skip = int(np.argmax(ends - starts))
    out: dict[tuple[int, int], tuple[int, int]] = {}
    for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if k == skip:
            continue
        for i in range(s, e):
            near = np.bitwise_count(fp ^ fp[i]) <= radius
            near[s:e] = False
            for j in np.flatnonzero(near).tolist():
                pair = (int(comp[i]), int(comp[j])) if comp[i] < comp[j] else (int(comp[j]), int(comp[i]))
                out.setdefault(pair, (int(fp[i : i + 1].view(np.int64)[0]), int(fp[j : j + 1].view(np.int64)[0])))
    return list(out.values())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Words are runs of non-white-space after lower-casing A-Z; shingles repeat
    and join with spaces; a text with fewer words is one shingle. A null,
    empty or blank text has fingerprint zero and is linked like any other.
    ``component_id`` is the smallest non-null id of the group (null if it has
    none). Repeated rows each get a row. Only the two named columns are read.
    An empty table gives an empty result.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n_rows")), "fingerprint-nodes")
    linked = link_components(nodes.select("fp"), radius)
    named = nodes.join(linked, "fp", "left").select("fp", "low", "n_rows", F.coalesce("component", "fp").alias("comp"))
    named = written(named, "named-fingerprints")
    lows = named.groupBy("comp").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n_kinds"))
    ids = join_groups(named, lows, ["comp"], "n_kinds").select("fp", "n_rows", "component_id")
    return join_groups(fps, ids, ["fp"], "n_rows").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the row with the smallest id.

    Rows without an id, and rows that repeat the smallest id, are dropped only
    where another row has the same id and text. Columns are those of ``docs``.
    Null, empty and blank texts share fingerprint zero, so one of them stays.
    An empty table stays empty.
    """
    rows = docs.select(row_node(id_col, text_col).alias("node"), F.col(text_col).alias("t"))
    found = near_duplicates(rows, "node", "t", shingle, radius)
    return keep_lowest(docs, found.select(F.col("doc_id").alias("node"), F.col("component_id").alias("component")).distinct(), id_col, text_col)


def row_node(id_col: str, text_col: str) -> Column:
    """A number of the id and the text: rows that share an id, but not the text, differ."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def keep_lowest(docs: DataFrame, linked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that stay by ``linked(node, component)``, of :func:`row_node`; nodes without a link may be missing."""
    (mark,) = fresh(docs.columns, "near_node")
    node = row_node(id_col, text_col)
    linked = written(linked, "near-components")
    ids = docs.select(node.alias("node"), F.col(id_col).cast("long").alias("id")).distinct()
    found = written(ids.join(linked, "node"), "near-ids")
    lows = found.groupBy("component").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n_ids"))
    out = written(join_groups(found, lows, ["component"], "n_ids").where("id <> low").select(F.col("node").alias(mark)).distinct(), "near-copies")
    # only rows that may be dropped shuffle with their texts
    maybe, sure = bloom.split(docs, F.xxhash64(node), out.select(F.xxhash64(mark).alias("k")), out.count())
    kept = sure.unionByName(maybe.join(out, node == F.col(mark), "left_anti"))
    again = docs.groupBy(node.alias(mark)).count().where("count > 1").select(mark)
    if again.isEmpty():
        return kept
    again = written(again, "repeated-rows")
    twice = kept.join(again, node == F.col(mark), "left_semi")
    once = kept.join(again, node == F.col(mark), "left_anti")
    return once.unionByName(twice.dropDuplicates([id_col, text_col]))
