"""A Merkle manifest of a table: one hash tree a group, and one over the groups.

A leaf is the hash of a row's columns. The leaves of a group, in order, are
the first level of its tree; every ``arity`` neighbours have a parent, the hash
of their digests, until one node is left: the group's root. The roots of the
groups, in the groups' order, are the leaves of the last tree.

A level is one window: partitioned by group and parent index, the ordered list
over the full frame is at most ``arity`` digests. It gives the parent's
preimage and each node's siblings; parents are deduplicated before the next
level. No window holds more than ``arity`` rows, so a group with most of the
rows is spread like any other. Places in a group come from a range partition
of the narrow rows (no texts) and prefix sums of its partitions' counts.
Proofs go down again: a node's proof is its siblings and its parent's proof,
one equi-join a level. The driver sees one digest, the root.

Nulls: each column of a leaf may be null and counts as ``-``; rows of a null
group are a group, the first; rows of a null order key come first in theirs.
Empty texts are ``0:``. Repeated rows are leaves of their own; rows that tie in
the order key are ordered by their leaf, so equal inputs give equal roots
whatever the partitions. Long texts are hashed in the engine, one at a time. An
empty table has an empty manifest and no root. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hot import join_groups
from .workspace import written

_NO_STEPS = "array()"
_STEPS = "array<struct<before:binary,after:binary>>"


def leaf(values: list[Column]) -> Column:
    """Hex SHA-256 of the values: each ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts += [F.coalesce(F.octet_length(text).cast("string"), F.lit("-")), F.when(text.isNull(), "").otherwise(F.concat(F.lit(":"), text))]
    return F.sha2(F.concat(*parts), 256)


def _hash(digests: Column) -> Column:
    """Binary SHA-256 of binary digests, concatenated as hex text."""
    return F.unhex(F.sha2(_hex(digests), 256))


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def places(rows: DataFrame, order: list[Column], place: str) -> DataFrame:
    """``rows`` with their place (from 0) in the order of the columns, which should not tie.

    A range partition, numbered in each partition; partitions begin where the
    counts before them end. ``rows`` should be narrow: all of them shuffle once.
    """
    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = written(rows.repartitionByRange(parts, *order).withColumn("part_", F.spark_partition_id()), "merkle-dealt")
    counts = dealt.groupBy("part_").agg(F.count(F.lit(1)).alias("rows_"))
    # one row a partition of the shuffle
    before = F.coalesce(F.sum("rows_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("part_", before.alias("base_"))
    number = F.row_number().over(Window.partitionBy("part_").orderBy(*order)).cast("long")
    numbered = dealt.withColumn("number_", number).join(F.broadcast(bases), "part_")
    return numbered.withColumn(place, F.col("base_") + F.col("number_") - 1).drop("part_", "base_", "number_")


@dataclass
class Forest:
    """The levels of trees that are built together.

    ``levels``: (tree, node, parent, n, digest, before, after), digests and the
    concatenated digests of the siblings on either side as binary, n the nodes
    of the tree's level. ``roots``: a table a level of (tree, digest), the trees
    that end there.
    """

    levels: list[DataFrame]
    roots: list[DataFrame]


def build(nodes: DataFrame, most: int, arity: int) -> Forest:
    """The trees over ``nodes`` (tree long, node long from 0, n long: nodes of the tree, digest binary); ``most``: the largest n."""
    forest = Forest([], [])
    while True:
        forest.roots.append(nodes.where("n = 1").select("tree", "digest"))
        if most <= 1:
            return forest
        most = -(-most // arity)
        wide = nodes.where("n > 1").withColumn("parent", F.expr(f"node div {int(arity)}"))
        run = Window.partitionBy("tree", "parent").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        at = (F.col("node") % arity).cast("int")
        empty = F.lit(b"")
        joined = wide.withColumn("run", F.collect_list("digest").over(run))
        joined = joined.withColumn("before", F.aggregate(F.slice("run", F.lit(1), at), empty, lambda a, d: F.concat(a, d)))
        joined = joined.withColumn("after", F.aggregate(F.slice("run", at + 2, F.lit(arity)), empty, lambda a, d: F.concat(a, d)))
        level = written(joined.drop("run"), "merkle-level")
        forest.levels.append(level)
        whole = F.concat("before", "digest", "after")
        nodes = level.select("tree", F.col("parent").alias("node"), F.expr(f"(n + {arity - 1}) div {int(arity)}").alias("n"), _hash(whole).alias("digest"))
        nodes = nodes.dropDuplicates(["tree", "node"])


def proofs(forest: Forest, ends: DataFrame) -> DataFrame | None:
    """(tree, node, steps) of the lowest level's nodes; None if no tree has two of them.

    ``steps``: siblings on either side, from the node up, then those of
    ``ends`` (tree, steps), what follows a tree's root.
    """
    above = None
    for number in range(len(forest.levels) - 1, -1, -1):
        # trees that end a level up, and the nodes of those that go on
        ended = forest.roots[number + 1].join(ends, "tree").select("tree", F.lit(0).cast("long").alias("parent"), F.col("steps").alias("rest"))
        if above is not None:
            ended = ended.unionByName(above.select("tree", F.col("node").alias("parent"), F.col("steps").alias("rest")))
        level = forest.levels[number]
        step = F.array(F.struct("before", "after"))
        found = level.join(ended, ["tree", "parent"]).select("tree", "node", F.concat(step, F.col("rest")).alias("steps"))
        # the lowest level is the largest; what reads it need not have it stored
        above = written(found, "merkle-proofs") if number else found
    return above


def manifest(rows: DataFrame, columns: list[str], group: str, order: str, arity: int = 3, check: dict[str, Column] | None = None) -> DataFrame:
    """(order, leaf, subroot, root, proof, claimed) of every row; hex digests.

    ``columns`` are hashed into the leaf; ``group`` names the trees, ordered as
    UTF-8 bytes; ``order`` orders the leaves. ``proof``: the siblings' steps
    from the leaf to the root (before, after: binary). ``claimed`` is the leaf
    of the row as it is now: with the columns of ``check`` in place of those of
    the same name (copies to verify), else the leaf itself. See :func:`folded`.
    """
    check = check or {}
    told = leaf([F.col(c) for c in columns])
    claimed = leaf([check.get(c, F.col(c)) for c in columns]) if check else told
    narrow = rows.select(
        F.col(order).alias("key"),
        F.col(group).cast("string").alias("group"),
        F.unhex(told).alias("digest"),
        F.unhex(claimed).alias("claimed"),
    )
    keyed = [F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("digest").asc()]
    # the range partition reads its input twice, so texts are hashed before
    placed = written(places(written(narrow, "merkle-hashed"), keyed, "place"), "merkle-places")

    groups = placed.groupBy("group").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n"))
    groups = written(places(groups, [F.col("group").asc_nulls_first()], "tree"), "merkle-groups")
    # the places of a group are consecutive, so its start tells its rows
    owned = placed.withColumn("named", F.coalesce(F.concat(F.lit(":"), F.col("group")), F.lit("")))
    facts = groups.select(F.coalesce(F.concat(F.lit(":"), F.col("group")), F.lit("")).alias("named"), "tree", "start", "n")
    leaves = join_groups(owned, facts, ["named"], "n").withColumn("node", F.col("place") - F.col("start"))
    leaves = written(leaves.select("tree", "node", "n", "key", "digest", "claimed"), "merkle-leaves")

    sizes = groups.agg(F.count(F.lit(1)), F.max("n")).first()
    many, most = sizes[0], sizes[1] or 0
    trees = build(leaves.select("tree", "node", "n", "digest"), most, arity)
    subroots = trees.roots[0]
    for more in trees.roots[1:]:
        subroots = subroots.unionByName(more)
    subroots = written(subroots, "merkle-subroots")
    top = build(
        subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("node"), F.lit(many).cast("long").alias("n"), "digest"), many, arity
    )
    last = top.roots[-1].first()
    root = F.lit(None if last is None else bytes(last["digest"]).hex()).cast("string")

    none = F.expr(_NO_STEPS).cast(_STEPS)
    one = rows.sparkSession.range(1).select(F.col("id").alias("tree"), none.alias("steps"))
    paths = proofs(top, one)
    if paths is None:  # one group, or none
        paths = subroots.select(F.col("tree").alias("node"), none.alias("steps"))
    ends = written(paths.select(F.col("node").alias("tree"), "steps"), "merkle-ends")

    single = trees.roots[0].join(ends, "tree").select("tree", F.lit(0).cast("long").alias("node"), "steps")
    deep = proofs(trees, ends)
    steps = single if deep is None else deep.unionByName(single)
    facts = subroots.withColumnRenamed("digest", "subroot").join(groups.select("tree", "n"), "tree")
    whole = join_groups(leaves.drop("n").join(steps, ["tree", "node"]), facts, ["tree"], "n")
    return whole.select(
        F.col("key").alias(order),
        _hex(F.col("digest")).alias("leaf"),
        _hex(F.col("subroot")).alias("subroot"),
        root.alias("root"),
        F.col("steps").alias("proof"),
        _hex(F.col("claimed")).alias("claimed"),
    )


def folded(claimed: Column, proof: Column) -> Column:
    """The root that a leaf (hex) and its proof give, to be compared with the manifest's."""
    return F.aggregate(proof, claimed, lambda d, s: F.sha2(F.concat(_hex(s["before"]), d, _hex(s["after"])), 256))


def proof_digest(proof: Column) -> Column:
    """Hex SHA-256 of all siblings of a proof, from the leaf up, left to right, as hex text."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(_hex(s["before"]), _hex(s["after"]))), ""), 256)
