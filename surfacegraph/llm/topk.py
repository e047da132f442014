"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length and cut into buckets. For a query, a bucket with
longest vector l and a running k-th best score t has the local cosine
threshold t / (|q| l): above one, the bucket cannot contribute. Otherwise the
bucket is pruned by length (vectors shorter than t / |q| are a suffix of it)
or, where the threshold is high, by one coordinate (a unit vector that has a
cosine of at least c with the query has its f-th coordinate in a known
interval), and the products of what is left are verified.

Queries are a stated set and go in blocks. A block is first scored against
the bucket of the longest vectors, which gives every query a threshold. The
buckets that could still matter to a block are then a prefix of their order,
found from counts by class of length. Blocks meet buckets in tiles of several
by several, so a block's vectors are sent once a tile and not once a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import written

#: Vectors a bucket, queries a block.
BUCKET = 4096
BLOCK = 512
#: Bytes of vectors in one tile, about.
TILE = 1 << 26
#: Scores are longs: no vector may be as long as this.
LONGEST = 2.0**31.5
#: Local cosine threshold from which coordinates prune better than lengths.
COORDINATE = 0.8
#: Products below this are exact in double precision.
EXACT = float(1 << 53)
HITS = "query_id long, vec_id long, score long"


def scaled(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<long>, norm double) of the vectors that take part, components floor(scale * x)."""
    v = F.col(vector_col)
    x = F.transform(v, lambda a: a.cast("double"))
    good = F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) != F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull()).where(F.coalesce(good, F.lit(False)))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda a: F.floor(a * F.lit(scale))).alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, a: s + a.cast("double") * a.cast("double"))))


def _packed(rows: DataFrame, size: int, width: int, partitions: int) -> DataFrame:
    """Blocks of at most ``size`` rows, in order of descending norm: (block, top, ids, data)."""

    def run(batches):
        from pyspark import TaskContext

        part, nth, held, n = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            while n >= size:
                t = pa.Table.from_batches(held)
                yield _block(t.slice(0, size), part, nth, width)
                held, n, nth = t.slice(size).to_batches(), n - size, nth + 1
        if n:
            yield _block(pa.Table.from_batches(held), part, nth, width)

    ordered = rows.repartitionByRange(partitions, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    return ordered.mapInArrow(run, "block long, top double, n int, ids binary, data binary")


def _block(t: pa.Table, part: int, nth: int, width: int) -> pa.RecordBatch:
    t = t.combine_chunks()
    ids = t.column("vec_id").to_numpy()
    data = np.zeros((len(ids), width), np.int64)
    lists = t.column("v").chunk(0) if t.column("v").num_chunks else pa.array([], pa.list_(pa.int64()))
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    lens = np.diff(offsets)
    row = np.repeat(np.arange(len(ids)), lens)
    col = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], lens)
    data[row, col] = flat[offsets[0] : offsets[-1]]
    return pa.RecordBatch.from_arrays(
        [pa.array([part * (1 << 32) + nth]), pa.array([float(t.column("norm")[0].as_py())]), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())],
        names=["block", "top", "n", "ids", "data"],
    )


def search_block(q_ids, q, floor, ids, data, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the candidates (ids, scores) of one bucket that may be among its k best.

    ``data`` is in order of descending length; ``floor`` has each query's
    k-th best score so far (-inf if unknown). At most k a query are returned.
    """
    qn, pn = np.sqrt((q.astype(float) ** 2).sum(1)), np.sqrt((data.astype(float) ** 2).sum(1))
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(data).max(initial=0)) * max(1, q.shape[1]) < EXACT
    qf, df = (q.astype(float), data.astype(float)) if exact else (q, data)
    unit = None
    top = pn[0] if len(pn) else 0.0
    slack = 1 + 1e-9
    out: list = [None] * len(q)
    by_length: list[tuple[int, int]] = []
    for i in range(len(q)):
        t = floor[i]
        if t <= 0 or not np.isfinite(t):
            by_length.append((i, len(data)))
            continue
        if qn[i] * top * slack < t:
            out[i] = (ids[:0], np.zeros(0, np.int64))
            continue
        last = int(np.searchsorted(-pn, -(t / qn[i]) / slack, "right"))
        local = t / (qn[i] * top)
        if local < COORDINATE:
            by_length.append((i, last))
            continue
        if unit is None:
            unit = df / np.maximum(pn, 1e-300)[:, None]
        c = min(1.0, local / slack)
        f = int(np.abs(q[i]).argmax())
        a = q[i, f] / qn[i]
        spread = np.sqrt(max(0.0, 1 - c * c) * max(0.0, 1 - a * a)) + 1e-9
        # the threshold grows for shorter vectors, so the interval of the longest holds for all
        column = unit[:last, f]
        low = a * c - spread
        high = 1.0 if a >= c else a * c + spread
        if a <= -c:
            low = -1.0
        pick = np.flatnonzero((column >= low - 1e-9) & (column <= high + 1e-9))
        out[i] = _best(df[pick] @ qf[i], ids[pick], q_ids[i], floor[i], k)
    by_length.sort(key=lambda x: -x[1])
    for at in range(0, len(by_length), 128):
        some = by_length[at : at + 128]
        most = some[0][1]
        scores = qf[[i for i, _ in some]] @ df[:most].T
        for row, (i, last) in zip(scores, some, strict=True):
            out[i] = _best(row[:last], ids[:last], q_ids[i], floor[i], k)
    return out


def _best(scores, ids, own, floor, k):
    keep = (ids != own) & (scores >= floor)
    scores, ids = scores[keep].astype(np.int64), ids[keep]
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= cut
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _found(found, q_ids) -> pa.RecordBatch:
    counts = [len(f[0]) for f in found]
    none = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(q_ids, counts)), pa.array(np.concatenate([f[0] for f in found] or [none])), pa.array(np.concatenate([f[1] for f in found] or [none]))],
        names=["query_id", "vec_id", "score"],
    )


def _array(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.int64).reshape(-1, width)


def _seed(width: int, k: int):
    """Hits of blocks in one bucket, without thresholds."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                q_ids = np.frombuffer(r["q_ids"], np.int64)
                yield _found(search_block(q_ids, _array(r["q_data"], width), np.full(len(q_ids), -np.inf), np.frombuffer(r["ids"], np.int64), _array(r["data"], width), k), q_ids)

    return run


def _tile(width: int, k: int):
    """Hits of a tile: its blocks, with thresholds, in its buckets, the longest first. A threshold rises with each bucket."""

    def run(blocks: pa.Table, buckets: pa.Table) -> pa.Table:
        out = [pa.RecordBatch.from_pylist([], schema=_HITS)]
        order = sorted(buckets.to_pylist(), key=lambda r: -r["top"])
        for b in blocks.to_pylist():
            q_ids, q, floor = np.frombuffer(b["q_ids"], np.int64), _array(b["q_data"], width), np.frombuffer(b["floors"], float).copy()
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q_ids)
            for r in order:
                got = search_block(q_ids, q, floor, np.frombuffer(r["ids"], np.int64), _array(r["data"], width), k)
                for i, (ids, scores) in enumerate(got):
                    if len(ids):
                        ids, scores = np.r_[best[i][0], ids], np.r_[best[i][1], scores]
                        first = np.lexsort((ids, -scores))[:k]
                        best[i] = ids[first], scores[first]
                        if len(first) == k:
                            floor[i] = max(floor[i], best[i][1][-1])
            out.append(_found(best, q_ids))
        return pa.Table.from_batches(out, schema=_HITS)

    return run


_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _placed(packed: DataFrame, name: str, side: int) -> DataFrame:
    """``packed`` with ``name``, its row's place in the order of length divided by ``side``: counts by task are the bases."""
    counts = packed.groupBy(F.shiftright("block", 32).cast("int").alias("part")).count().orderBy("part").collect()  # a row a task
    bases, total = [], 0
    for r in counts:
        bases.append((r["part"], total))
        total += r["count"]
    bases = packed.sparkSession.createDataFrame(bases, "part int, base long")
    at = F.col("base") + F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
    return packed.withColumn("part", F.shiftright("block", 32).cast("int")).join(F.broadcast(bases), "part").withColumn(name, F.floor(at / side)).drop("part", "base")


def _class(length: Column) -> Column:
    """A class of vector lengths, eight to an octave: at most a few hundred."""
    return F.floor(F.log2(F.greatest(length, F.lit(1e-9))) * 8).cast("int")


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    bucket: int = BUCKET,
    block: int = BLOCK,
    tile_bytes: int = TILE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for each query row, exactly.

    Components are floor(scale * x), scores integer inner products, ties go to
    the smaller id. Candidates are all rows but those with the query's own id.
    Vectors that are null, or hold a null, NaN or infinite component, and rows
    without an id take no part; shorter vectors are filled with zeros. Rows
    that repeat a query's id are one query (its least vector); repeated
    candidates count each. With fewer than k candidates all are returned. An
    empty table gives an empty result. Scores are longs: a scaled vector of
    length 2**31.5 or more raises, as its products may not fit.
    """
    spark = vectors.sparkSession
    rows = written(scaled(vectors, scale, id_col, vector_col), "scaled-vectors")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max("norm").alias("longest")).first()
    total, width = facts["n"], max(1, facts["width"] or 1)
    if (facts["longest"] or 0) >= LONGEST:
        raise OverflowError(f"a scaled vector has length {facts['longest']:g}; scores would not fit a long")
    chosen = rows.where(is_query)
    queries = chosen.groupBy("vec_id").agg(F.min(F.struct("v", "norm")).alias("x")).select("vec_id", "x.v", "x.norm")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    side = max(1, min(16, tile_bytes // (8 * width * (bucket + block))))
    buckets = _placed(written(_packed(rows, bucket, width, max(1, min(n, -(-total // bucket)))), "norm-buckets"), "bi", side)
    blocks = _placed(written(_packed(queries, block, width, max(1, min(n, -(-total // (50 * block))))), "query-blocks"), "qj", side)
    blocks = blocks.select("qj", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))

    # first pass: every block against the bucket of the longest vectors that has more than k
    first = buckets.select("block", "top", "n").orderBy(F.desc(F.col("n") > k), F.desc("top"), "block").limit(1)
    longest = written(buckets.join(first.select("block"), "block", "left_semi").select("block", "ids", "data"), "longest-bucket")  # one row
    seeded = blocks.select("q_ids", "q_data").crossJoin(F.broadcast(longest.select("ids", "data")))
    head = written(seeded.mapInArrow(_seed(width, k), HITS), "first-hits")
    floors = head.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))

    # thresholds by block, in the order of its queries
    def members(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, data = np.frombuffer(r["q_ids"], np.int64), _array(r["q_data"], width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), r["q_block"])), pa.array(np.arange(len(ids))), pa.array(ids), pa.array(np.sqrt((data.astype(float) ** 2).sum(1)))],
                    names=["q_block", "at", "query_id", "q_norm"],
                )

    named = blocks.select("q_block", "q_ids", "q_data").mapInArrow(members, "q_block long, at long, query_id long, q_norm double")
    named = named.join(floors, "query_id", "left")
    # the shortest vector that could still matter to some query of the block
    ratio = F.when(F.col("floor") > 0, F.col("floor") / F.col("q_norm")).otherwise(0.0)
    limits = named.groupBy("q_block").agg(
        F.min(ratio).alias("least"),
        F.sort_array(F.collect_list(F.struct("at", F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf"))).alias("floor")))).alias("floors"),
    )

    def pack_floors(batches):
        for b in batches:
            packed = [np.array([f["floor"] for f in r], float).tobytes() for r in b.column("floors").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("q_block"), b.column("least"), pa.array(packed, pa.binary())], names=["q_block", "least", "floors"])

    limits = written(limits.mapInArrow(pack_floors, "q_block long, least double, floors binary"), "block-limits")

    # the tiles of a row of blocks: buckets from the longest to those of the class of the shortest that matters
    classes = buckets.groupBy("bi").agg(F.max("top").alias("top")).groupBy(_class(F.col("top")).alias("class")).agg((F.max("bi") + 1).alias("reach"))
    classes = classes.orderBy("class").collect()  # a few hundred rows, whatever the input
    reach, most = F.lit(0).cast("long"), 0
    for c in sorted(classes, key=lambda r: -r["class"]):
        most = max(most, c["reach"])
        reach = F.when(F.col("class") <= c["class"], F.lit(most)).otherwise(reach)
    work = blocks.join(limits, "q_block")
    rows_ = work.groupBy("qj").agg(F.min("least").alias("least")).select("qj", _class(F.col("least") * (1 - 1e-9)).alias("class"))
    tiles = written(rows_.select("qj", reach.alias("reach")).where("reach > 0").select("qj", F.explode(F.sequence(F.lit(0).cast("long"), F.col("reach") - 1)).alias("bi")), "tiles")
    rest = buckets.join(longest.select("block"), "block", "left_anti")
    left = tiles.join(work.select("qj", "q_ids", "q_data", "floors"), "qj")
    right = tiles.select(F.col("qj").alias("r_qj"), F.col("bi").alias("r_bi")).join(rest.select(F.col("bi").alias("r_bi"), "top", "ids", "data"), "r_bi")
    more = left.groupBy("qj", "bi").cogroup(right.groupBy("r_qj", "r_bi")).applyInArrow(_tile(width, k), HITS)
    top = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    hits = head.unionByName(more).withColumn("rank", top.cast("int")).where(F.col("rank") <= k)
    return hits.select("query_id", "rank", "vec_id", "score")
