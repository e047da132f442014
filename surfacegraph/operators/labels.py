"""Interval labels of forests: descendants and ancestors by comparing two numbers.

Pre-order numbers make a subtree one interval. They come from three passes
whose number of steps is the logarithm of the depth, not the depth: pointers
that double their reach add up the sizes of subtrees; running sums over the
sorted siblings give each node its distance from its parent; and the pointers,
doubling again, add these up to the root. No table of all (node, ancestor)
pairs is made, and no level is joined by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import stored
from ..plans.prefix import running_sum

#: Doublings; a path longer than two to the power of this is a cycle.
MOST_DOUBLINGS = 40


def climb(nodes: DataFrame, combine: dict[str, Callable[[Column, Column], Column]], below: str | None = None) -> DataFrame:
    """``nodes`` (id, up, and value columns) with each value combined with those of all nodes above.

    ``up`` is the parent; a parent that is no node ends the path. ``combine``
    maps a value column to an associative function of (own, the upper one's).
    ``below`` names a column that is added up over the subtree instead. Raises
    if parents form a cycle.
    """
    ids = nodes.select(F.col("id").alias("up"))
    has = nodes.where("up is not null").join(ids, "up", "left_semi").select("id", F.col("up").alias("known"))
    state = stored(nodes.join(has, "id", "left").withColumn("up", F.col("known")).drop("known"))
    most = None
    for step in range(MOST_DOUBLINGS):
        moving = state.where("up is not null")
        left = moving.count()
        if not left:
            return state
        # the longest path has as many steps as there are nodes below a root
        most = left if most is None else most
        if (1 << step) > 2 * most:
            break
        upper = state.select(F.col("id").alias("up"), F.col("up").alias("u_up"), *[F.col(c).alias(f"u_{c}") for c in combine])
        # nodes that have arrived need no partner; a null is no hot key
        moved = moving.join(upper, "up")
        moved = moved.withColumns({c: f(F.col(c), F.col(f"u_{c}")) for c, f in combine.items()}).withColumn("up", F.col("u_up"))
        nxt = moved.select(state.columns).unionByName(state.where("up is null"))
        if below:
            sums = moving.groupBy(F.col("up").alias("id")).agg(F.sum(below).alias("u_below"))
            nxt = nxt.join(sums, "id", "left").withColumn(below, F.col(below) + F.coalesce("u_below", F.lit(0))).drop("u_below")
        state = stored(nxt.select(state.columns))
    raise ValueError("layout parents form a cycle")


def intervals(nodes: DataFrame, tree: str = "page_id") -> DataFrame:
    """(tree, id, pre, last, depth) of ``nodes`` (tree, id, parent, order): ``pre`` counts from 0 in each tree, in pre-order.

    The subtree of a node is what has ``pre`` from its own to ``last``. Siblings,
    and the roots of a tree, are sorted by ``order``, then id. A parent that is
    no node makes a root. Raises on a cycle.
    """
    base = nodes.select(F.col(tree).alias("tree"), "id", F.col("parent").alias("up"), "order")
    # most nodes have no children: only the others take part in the doublings
    kids = base.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    inner = stored(base.select("id", "up").join(kids, "id"))
    among = inner.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.count(F.lit(1)).alias("n_inner"))
    leaves = F.col("n") - F.coalesce("n_inner", F.lit(0))
    ones = inner.join(among, "id", "left").select("id", "up", (leaves + 1).alias("size"), F.lit(1).cast("long").alias("depth"))
    sized = climb(ones, {"depth": lambda a, b: a + b}, below="size").select("id", "size", (F.col("depth") - 1).alias("depth"))
    rows = base.join(sized, "id", "left").withColumn("size", F.coalesce("size", F.lit(1).cast("long")))
    # a parent that is no node counts as none; a null is no hot key
    under = rows.where("up is not null").join(sized.select(F.col("id").alias("up"), F.lit(True).alias("known")), "up", "left")
    rows = rows.where("up is null").unionByName(under.withColumn("up", F.when(F.col("known"), F.col("up"))).drop("known"))
    placed = stored(running_sum(rows, ["tree", "up"], ["order", "id"], F.col("size"), "before").drop("order"))
    # a child comes after its parent and its earlier siblings' subtrees
    own = F.col("before") + F.when(F.col("up").isNull(), 0).otherwise(1)
    found = ["tree", "id", "pre", "size", "depth"]
    high = climb(placed.where("depth is not null").select("tree", "id", "up", own.alias("pre"), "size", "depth"), {"pre": lambda a, b: a + b}).select(found)
    low = placed.where("depth is null")
    alone = low.where("up is null").select("tree", "id", own.alias("pre"), "size", F.lit(0).cast("long").alias("depth"))
    below = low.where("up is not null").join(high.select(F.col("id").alias("up"), F.col("pre").alias("u_pre"), F.col("depth").alias("u_depth")), "up")
    below = below.select("tree", "id", (own + F.col("u_pre")).alias("pre"), "size", (F.col("u_depth") + 1).alias("depth"))
    every = high.unionByName(alone).unionByName(below)
    return every.select(F.col("tree").alias(tree), "id", "pre", (F.col("pre") + F.col("size") - 1).alias("last"), "depth")


def from_edges(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """:func:`intervals` of one forest, of nodes (id) and edges (src, dst, kind, seq) from parent to child; of several parents the first edge's counts."""
    one = edges.where((F.col("kind") == kind) & F.col("dst").isNotNull()).groupBy(F.col("dst").alias("id"))
    above = one.agg(F.min(F.struct(F.col("seq").alias("order"), F.col("src").alias("parent"))).alias("e")).select("id", "e.*")
    named = nodes.select("id").join(above, "id", "left").withColumn("tree", F.lit(0))
    return intervals(named, "tree").drop("tree")


def descendants(labels: DataFrame, node: str, depth: int | None = None) -> DataFrame:
    """(id, hops, pre) of nodes below ``node``, to ``depth`` levels; sorted by ``pre`` they are in document order."""
    at = labels.where(F.col("id") == node).select(F.col("pre").alias("a"), F.col("last").alias("z"), F.col("depth").alias("d"))
    # one row; a filter by its numbers
    found = labels.join(F.broadcast(at), (F.col("pre") > F.col("a")) & (F.col("pre") <= F.col("z")))
    hops = (F.col("depth") - F.col("d")).cast("int")
    found = found.select("id", hops.alias("hops"), "pre")
    return found if depth is None else found.where(F.col("hops") <= depth)


def ancestors(labels: DataFrame, node: str, depth: int | None = None) -> DataFrame:
    """(id, hops) of nodes above ``node``, to ``depth`` levels."""
    at = labels.where(F.col("id") == node).select(F.col("pre").alias("a"), F.col("depth").alias("d"))
    found = labels.join(F.broadcast(at), (F.col("pre") < F.col("a")) & (F.col("last") >= F.col("a")))
    found = found.select("id", (F.col("d") - F.col("depth")).cast("int").alias("hops"))
    return found if depth is None else found.where(F.col("hops") <= depth)
