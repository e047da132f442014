"""Near copies by the Jaccard similarity of word shingles: SimHash, covering LSH, exact verification.

A text is the set of its word shingles, each a 64-bit hash, and its
fingerprint a SimHash of the set, as long as it takes. Parts of the
fingerprint each have the covering masks of ``simhash.masks``; two texts meet
in a bucket if they agree on a mask of a part, as they always do where a part
differs in at most ``RADIUS`` bits. ``plan`` takes as many parts as leave a
pair of the similarity asked for apart with probability ``MISS`` at most.
A row serves the buckets of ``TOGETHER`` masks and is dealt by the bits that
these have in common.

In a bucket only texts stay together whose sizes allow the similarity and whose
first ``CHECK`` bits are near, in any number of steps. Those are compared by
their whole sets, so a link always has the similarity asked for.

Buckets that share texts are one group, and a text's set goes to its group, not
to each of its buckets. A group of at most two blocks is one cell, which gives
a forest of its links: nothing is left there. Larger groups are dealt to cells
of about a block, ``PASSES`` times and each time anew, so that what is alike
becomes one component; what is then left of several components is compared
block by block, and only texts of different components, as in
``simhash.link_components``. Where the buckets of a large group are so sparse
that fewer rows meet in them, they stay in the place of the group.
"""

from __future__ import annotations

import math
from functools import cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom, text_tokens
from .components import components
from .hot import join_groups
from .simhash import LOWER, keep_lowest, masks, row_node
from .workspace import bound_batches, by_bytes, settle, written

#: Differing bits of a part that its masks always cover.
RADIUS = 2
#: Greatest probability that two similar texts share no bucket, and that the check parts them.
MISS, CHECK_MISS = 1.5e-5, 1e-6
#: Bits of the fingerprint that a bucket's rows carry.
CHECK = 192
#: Unlike texts that share a bucket, about.
MATES = 512
#: Texts of a group in one block.
BLOCK = 256
#: Times that a large group is dealt to cells before its blocks meet.
PASSES = 2
#: Bytes of rows of buckets that a task takes at a time, about.
SHARD = 16_000_000
#: Masks of a part whose buckets one row serves; any two have two sevenths of the bits in common.
TOGETHER = 2
#: Steps of a size that doubles.
STEPS = 256


@cache
def constants(n: int, seed: int) -> np.ndarray:
    """Odd 64-bit multipliers."""
    return np.random.default_rng(seed).integers(0, 1 << 64, n, np.uint64, endpoint=False) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, size: int) -> np.ndarray:
    """The text's different word shingles as sorted hashes; a text with fewer words is one shingle."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(1, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    by, n = constants(size, 5), max(1, len(words) - size + 1)
    total = np.zeros(n, np.uint64)
    for j in range(min(size, len(words))):
        total += h[j : j + n] * by[j]
    return np.unique(mixed(total))


class Plan(NamedTuple):
    """How texts meet: parts of so many bits, and the differing bits of ``CHECK`` up to which they stay together."""

    bits: int
    parts: int
    near: int

    @property
    def words(self) -> int:
        """64-bit words of a fingerprint."""
        return -(-max(CHECK, self.bits * self.parts) // 64)

    @property
    def together(self) -> list[list[int]]:
        """The numbers of the masks whose buckets a row serves; a row for each list and part."""
        n = len(masks(RADIUS))
        return [list(range(i, min(n, i + TOGETHER))) for i in range(0, n, TOGETHER)]

    @property
    def row(self) -> np.dtype:
        """A row: the part and the list of masks, the part's bits, the text."""
        return np.dtype([("which", "<u2"), ("part", "<u4" if self.bits <= 32 else "<u8"), ("node", "<i8"), ("size", "<u2"), ("bits", "<u8", CHECK // 64)])


def differ(least: float) -> float:
    """The greatest probability that a bit of the fingerprint differs between sets of similarity ``least`` or more.

    For large sets it is that of the angle between them. Small sets are
    counted out: votes are whole numbers, so they tie more often.
    """
    votes = [np.ones(1)]  # votes[n]: chances of the sums -3n, -3n + 2, ..., 3n of n shingles
    for _ in range(40):
        votes.append(np.convolve(votes[-1], np.full(4, 0.25)))
    worst = math.acos(2 * least / (1 + least)) / math.pi
    for both in range(1, 20):
        own = [m for m in range(21) if both >= least * (both + m) - 1e-9]
        sums = 2 * np.arange(3 * both + 1) - 3 * both
        won = [np.array([votes[m][2 * np.arange(3 * m + 1) - 3 * m > -s].sum() for s in sums]) for m in own]
        for a in own:
            for b in own[a : len(own) - a]:
                worst = max(worst, float(votes[both] @ (won[a] * (1 - won[b]) + won[b] * (1 - won[a]))))
    return worst


def meets(bits: int, apart: float) -> float:
    """The probability that a part of so many bits, each differing with probability ``apart``, agrees on a mask."""
    each, total = masks(RADIUS, bits=bits), 0.0
    for k in range(1, len(each) + 1):
        for some in combinations(each, k):
            total -= (-1) ** k * (1 - apart) ** np.bitwise_or.reduce(some).bit_count()
    return total


@cache
def plan(texts: int, least: float) -> Plan:
    """The plan for a table of so many texts: longer parts for more texts, so buckets do not grow with the table."""
    apart = differ(least)
    # a mask has 4 of 7 bits of its part
    bits = min(56, max(14, round(math.log2(max(1, texts) / MATES + 1) * 7 / 4)))
    parts = math.ceil(math.log(MISS) / math.log(1 - meets(bits, apart)))
    left, near = 1.0, -1
    while left > CHECK_MISS:
        near += 1
        left -= math.comb(CHECK, near) * apart**near * (1 - apart) ** (CHECK - near)
    return Plan(bits, parts, near)


def fingerprint(s: np.ndarray, words: int) -> np.ndarray:
    """SimHash of a set of hashes, as 64-bit words: in each bit a shingle votes with 1 or 3, for or against."""
    votes = np.zeros(words * 64, np.int64)
    for weight, seed in ((1, 6), (2, 7)):
        flip, by = constants(64, seed + 2)[:words], constants(64, seed)[:words]
        for at in range(0, len(s), 255):  # so many fit a byte
            h = mixed((s[at : at + 255, None] ^ flip) * by)
            votes += weight * np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1), axis=0, dtype=np.uint8).astype(np.int64)
    return np.packbits(2 * votes > 3 * len(s)).view(np.uint64)


def parts(prints: np.ndarray, plan: Plan) -> np.ndarray:
    """(text, part): the bits of the parts of fingerprints (text, word), as numbers."""
    flat = np.unpackbits(prints.view(np.uint8), axis=1)[:, : plan.bits * plan.parts].reshape(len(prints), plan.parts, plan.bits)
    wide = np.zeros((len(prints), plan.parts, 64), np.uint8)
    wide[:, :, : plan.bits] = flat
    # bit i of a part is bit i of a number
    return np.packbits(wide, axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def bucket(part: np.ndarray, which: np.ndarray, mask: int, plan: Plan) -> np.ndarray:
    """The bucket, as a 64-bit hash, of parts of the numbers ``which`` by one of the masks."""
    each = np.array(masks(RADIUS, bits=plan.bits), np.int64).view(np.uint64)
    return mixed(mixed(part & each[mask]) + constants(plan.parts * len(each), 9)[which * len(each) + mask])


def buckets(prints: np.ndarray, plan: Plan) -> np.ndarray:
    """(text, mask of a part): the buckets of fingerprints (text, word)."""
    part, which = parts(prints, plan), np.arange(plan.parts)
    return np.stack([bucket(part, which, m, plan) for ms in plan.together for m in ms], axis=2).reshape(len(prints), -1)


def sized(sizes: np.ndarray) -> np.ndarray:
    """The sizes on a scale of ``STEPS`` to a doubling."""
    return (STEPS * np.log2(sizes)).astype(np.uint16)


def clusters(bits: np.ndarray, near: int, size: np.ndarray | None = None, least: float = 0.0) -> list[np.ndarray]:
    """Positions of the rows that at most ``near`` differing bits join, in any number of steps; single rows fall out.

    With ``size``, of :func:`sized`, only rows join whose sets may have the similarity ``least``.
    """
    if size is not None:
        size, reach = size.astype(np.int32), math.ceil(-STEPS * math.log2(least)) + 1

    def close(a, b):
        apart = np.zeros((len(a), len(b)), np.uint8)
        for w in range(bits.shape[1]):
            apart += np.bitwise_count(bits[a, None, w] ^ bits[None, b, w])
        out = apart <= near
        return out if size is None else out & (np.abs(size[a, None] - size[None, b]) <= reach)

    left, out = np.arange(len(bits)), []
    if len(left) <= 4 * MATES:  # most rows are single
        left = left[close(left, left).sum(1) > 1]
    while len(left) > 1:
        group = [left[:1]]
        todo, left = left[:1], left[1:]
        while len(todo) and len(left):
            step = max(1, (1 << 20) // len(left))
            hit = close(todo[:step], left).any(0)
            new, left = left[hit], left[~hit]
            todo = np.concatenate([todo[step:], new])
            group.append(new)
        group = np.concatenate(group)
        if len(group) > 1:
            out.append(group)
    return out


def forest(sets: list[np.ndarray], comp: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links (positions) of similarity ``least`` or more that join all components they can join.

    Holds the hashes once more, to find those that sets have in common; of the
    rest, which decide nothing but the sizes, no more than their number.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    kinds = np.concatenate(sets)
    kinds.sort()
    kinds = np.unique(kinds[1:][kinds[1:] == kinds[:-1]])
    if not len(kinds):
        return []
    shared = []
    for s in sets:
        at = np.minimum(np.searchsorted(kinds, s), len(kinds) - 1)
        shared.append(at[kinds[at] == s].astype(np.int32))
    held = np.fromiter(map(len, shared), np.int64, len(sets))
    _, comp = np.unique(comp, return_inverse=True)
    skip = int(np.bincount(comp).argmax())  # the largest component is never the row side
    comp, hit, out = comp.copy(), np.zeros(len(kinds), bool), []
    for i in np.flatnonzero(comp != skip).tolist():
        # what is common is at most what either set shares with others
        may = (comp != comp[i]) & (np.minimum(held, held[i]) >= least * np.maximum(sizes, sizes[i]))
        others = np.flatnonzero(may).tolist()
        if not others:
            continue
        hit[shared[i]] = True
        for j in others:
            if comp[j] != comp[i]:
                both = int(np.count_nonzero(hit[shared[j]]))
                if both >= least * (sizes[j] + sizes[i] - both):
                    out.append((i, j))
                    comp[comp == comp[j]] = comp[i]
        hit[shared[i]] = False
    return out


def _signed(rows: DataFrame, shingle: int, words: int) -> DataFrame:
    def run(batches):
        text_tokens.release()
        for b in by_bytes(batches, 1):
            sets = [shingles(t, shingle) for t in b.column(1).to_pylist()]
            got = [fingerprint(s, words).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary()), pa.array(map(len, sets), pa.int64())], names=["node", "print", "size"])

    return rows.mapInArrow(run, "node long, print binary, size long")


def _dealt(signed: DataFrame, plan: Plan, shards: int) -> DataFrame:
    """(shard, rows): a row for each text, part and list of masks, many to a binary, dealt by the bits that the masks have in common."""

    def run(batches):
        each = np.array(masks(RADIUS, bits=plan.bits), np.int64).view(np.uint64)
        common = np.array([np.bitwise_and.reduce(each[ms]) for ms in plan.together])
        which = np.arange(plan.parts * len(common))
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                prints = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(b.num_rows, plan.words)
                part = np.repeat(parts(prints, plan), len(common), axis=1)
                rows = np.empty(part.shape, plan.row)
                rows["which"] = which
                rows["part"] = part
                rows["node"] = b.column(0).to_numpy()[:, None]
                rows["size"] = sized(b.column(2).to_numpy())[:, None]
                rows["bits"] = prints[:, None, : CHECK // 64]
                keys = mixed(mixed(part & common[which % len(common)]) + constants(len(which), 11))
                rows, to = rows.ravel(), (keys % np.uint64(shards)).ravel()
                order = np.argsort(to, kind="stable")
                rows, to = rows[order], to[order]
                starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                ends = np.r_[starts[1:], len(to)]
                blobs = [rows[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(to[starts].astype(np.int64)), pa.array(blobs, pa.binary())], names=["shard", "rows"])
        settle()

    return signed.mapInArrow(run, "shard long, rows binary")


def lowest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest position that links ``a[i]`` to ``b[i]`` lead to, for each of ``n`` positions."""
    low = np.arange(n)
    while True:
        was, least = low.copy(), np.minimum(low[a], low[b])
        for x in (a, b, was[a], was[b]):
            np.minimum.at(low, x, least)
        low = low[low]
        if (low == was).all():
            return low


def _met(dealt: DataFrame, plan: Plan, least: float, linked: bool = True) -> DataFrame:
    """(first, node, rows): the nodes that clusters of a shard's buckets join, the smallest of them, and how many clusters hold the node.

    Not ``linked``: (bucket, node), the clusters; those of the same texts have the same number.
    """

    def run(t: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(t.column("rows").to_pylist()), plan.row)
        which, ms = np.divmod(rows["which"].astype(np.int64), len(plan.together))
        found: dict[int, np.ndarray] = {}
        for k, m in [(k, m) for k, some in enumerate(plan.together) for m in some]:
            at = np.flatnonzero(ms == k)
            key = bucket(rows["part"][at].astype(np.uint64), which[at], m, plan)
            order = np.argsort(key)
            key, at = key[order], at[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = np.r_[starts[1:], len(key)]
            many = ends - starts > 1
            for s, e in zip(starts[many].tolist(), ends[many].tolist(), strict=True):
                some = rows[at[s:e]]
                for group in clusters(np.ascontiguousarray(some["bits"]), plan.near, some["size"], least):
                    nodes = np.unique(some["node"][group])
                    if len(nodes) > 1:
                        found[int(mixed(nodes.view(np.uint64) * constants(1, 10)).sum(dtype=np.uint64).view(np.int64))] = nodes
        del rows, which, ms
        settle()
        sizes = [len(x) for x in found.values()]
        node = np.concatenate([np.empty(0, np.int64), *found.values()])
        if not linked:
            return pa.table({"bucket": np.repeat(np.array(list(found), np.int64), sizes), "node": node})
        firsts = np.repeat(np.array([x[0] for x in found.values()], np.int64), sizes)
        nodes, at, n = np.unique(node, return_inverse=True, return_counts=True)
        low = lowest(np.searchsorted(nodes, firsts), at, len(nodes))
        return pa.table({"first": nodes[low], "node": nodes, "rows": n})

    return dealt.groupBy("shard").applyInArrow(run, "first long, node long, rows long" if linked else "bucket long, node long")


def _grouped(joined: DataFrame, block: int) -> DataFrame:
    """(component, n, node, large, sparse): the groups of ``joined(first, node, rows)``, n texts each.

    ``large`` groups have more than two blocks; ``sparse`` ones have fewer
    rows in clusters than would go to cells of the group.
    """
    group = written(components(joined.select(F.col("first").alias("a"), F.col("node").alias("b"))), "similar-groups")
    held = joined.groupBy("node").agg(F.sum("rows").alias("rows")).join(group, "node")
    sizes = held.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"))
    large = F.col("n") > 2 * block
    sparse = large & (F.col("n") * F.ceil(F.col("n") / block) > F.col("rows"))
    sizes = sizes.select("component", "n", large.alias("large"), sparse.alias("sparse"))
    return written(join_groups(group, sizes, ["component"], "n"), "similar-named")


def _members(signed: DataFrame, plan: Plan, least: float, block: int) -> DataFrame:
    """(bucket, n, node, large): what is compared together, a group or else a cluster of a sparse one, and whether the group is large."""

    def dealt(rows):
        size = rows.count() * plan.parts * len(plan.together) * plan.row.itemsize
        return _dealt(rows, plan, -(-size // SHARD) or 1)

    named = _grouped(written(_met(dealt(signed), plan, least), "similar-links"), block)
    whole = named.where("not sparse").select(F.col("component").alias("bucket"), "n", "node", "large")
    some = named.where("sparse").select("node")
    if some.isEmpty():
        return whole
    again = written(signed.join(some, "node", "left_semi").select(signed.columns), "sparse-signatures")
    keyed = written(_met(dealt(again), plan, least, linked=False).distinct(), "sparse-clusters")
    many = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return whole.unionByName(join_groups(keyed, many, ["bucket"], "n").withColumn("large", F.lit(True)))


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """``rows``, texts ``t``, with the ``set`` of each in the place of the text."""
    kept = [c for c in rows.columns if c != "t"]
    rows = rows.select("t", *kept)

    def run(batches):
        for b in by_bytes(batches, 0):
            got = [shingles(t, shingle).tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(got, pa.binary())], names=[*kept, "set"])

    return rows.mapInArrow(run, ", ".join(f"{c} {kind}" for c, kind in rows.dtypes[1:]) + ", set binary")


def _links(cells: DataFrame, least: float) -> DataFrame:
    """(a, b): the forests of the cells (bucket, cell, node, comp, set)."""

    def run(t: pa.Table) -> pa.Table:
        node, at = np.unique(t.column("node").to_numpy(), return_index=True)
        sets = t.column("set")
        links = forest([np.frombuffer(sets[i].as_py(), np.uint64) for i in at.tolist()], t.column("comp").to_numpy()[at], least)
        a, b = (np.array([x[k] for x in links], np.int64) for k in (0, 1))
        del sets
        settle()
        return pa.table({"a": node[a], "b": node[b]})

    return cells.select("bucket", "cell", "node", "comp", "set").groupBy("bucket", "cell").applyInArrow(run, "a long, b long")


def _named(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with ``comp``, the component of the node by the links."""
    first = components(links).select(F.col("node").alias("at"), "component")
    return members.join(first, F.col("node") == F.col("at"), "left").select(*members.columns, F.coalesce("component", "node").alias("comp"))


def _dealt_anew(n: str, block: int, turn: int) -> Column:
    """The cell of a node, of ``n`` that are compared together, in this pass."""
    cell = F.pmod(F.xxhash64("node", F.lit(3 + turn)), F.ceil(F.col(n) / block)).cast("string")
    return F.when(F.col(n) <= 2 * block, F.lit("all")).otherwise(cell)


def similar_links(rows: DataFrame, shingle: int = 5, least: float = 0.8, block: int = BLOCK) -> DataFrame:
    """(a, b): links that join all rows of ``rows(node long, t string)`` that are similar, in any number of steps.

    ``node`` tells texts apart: rows with the same node have the same text.
    """
    bound_batches(rows.sparkSession)
    how = plan(rows.count(), least)
    signed = written(_signed(rows, shingle, how.words).dropDuplicates(["node"]), "signatures")
    members = written(_members(signed, how, least, block), "similar-members")

    home = members.groupBy("node").agg(F.max(F.struct("n", "bucket", "large")).alias("home")).select("node", "home.*")
    home = written(home.withColumn("cell", _dealt_anew("n", block, 0)), "similar-homes")
    maybe, _ = bloom.split(rows, F.xxhash64("node"), home.select(F.xxhash64("node").alias("k")), home.count())
    sets = written(_sets(maybe.join(home, "node"), shingle), "shingle-sets").withColumn("comp", F.col("node"))
    near = written(_links(sets.where("not large"), least), "home-links")
    sets = sets.where("large")
    if sets.isEmpty():
        return near
    return near.unionByName(_large_links(members.where("large"), sets, least, block))


def _large_links(members: DataFrame, sets: DataFrame, least: float, block: int) -> DataFrame:
    """The links of large groups, of their ``members`` and the ``sets`` of these."""
    near = written(_links(sets, least), "large-links")
    for turn in range(1, PASSES):
        again = _named(sets.where(F.col("n") > 2 * block).drop("comp", "cell", "set"), near).withColumn("cell", _dealt_anew("n", block, turn))
        again = again.join(sets.select("node", "set"), "node")
        near = near.unionByName(written(_links(again, least), "large-links"))

    named = written(_named(members, near), "named-similar")
    held = named.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("m"))
    open_ = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("many")).where("comps > 1")
    todo = join_groups(named, open_.select("bucket", F.col("top.comp").alias("main"), F.col("top.m").alias("mains"), "many"), ["bucket"], "many")
    # rows of the dominant component go to one block, the others to every
    # block of it and to each pair of their own
    h = F.xxhash64("node", F.lit(3))
    main_blocks = F.ceil(F.col("mains") / block).cast("int")
    own_blocks = F.ceil((F.col("n") - F.col("mains")) / block).cast("int")
    own = F.pmod(h, own_blocks).cast("int")
    to = (
        F.when(F.col("n") <= 2 * block, F.array(F.lit("all")))
        .when(F.col("comp") == F.col("main"), F.transform(F.sequence(F.lit(0), own_blocks - 1), lambda j: F.concat_ws(":", F.pmod(h, main_blocks), j)))
        .otherwise(
            F.concat(
                F.transform(F.sequence(F.lit(0), main_blocks - 1), lambda i: F.concat_ws(":", i, own)),
                F.transform(F.sequence(F.lit(0), own_blocks - 1), lambda j: F.concat_ws("|", F.least(j, own), F.greatest(j, own))),
            )
        )
    )
    cells = todo.select("bucket", F.explode(to).alias("cell"), "node", "comp")
    return near.unionByName(written(_links(cells.join(sets.select("node", "set"), "node"), least), "cross-links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of linked texts the row with the smallest id.

    Rows without an id, and rows that repeat the smallest id, are dropped only
    where another row has the same id and text. Columns are those of ``docs``.
    Null, empty and blank texts have the same set, so one of them stays. A text
    is one set in a worker, however long. An empty table stays empty.
    """
    rows = docs.select(row_node(id_col, text_col).alias("node"), F.col(text_col).alias("t"))
    return keep_lowest(docs, components(similar_links(rows, shingle, least, block)), id_col, text_col)
