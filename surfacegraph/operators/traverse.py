"""Traversal: reachability, breadth-first enumeration and shortest paths.

Searches go level by level over the edge table. A level is one join of the
frontier with the edges and one anti-join with what is known; each level is
cut from its lineage. Ties are settled as a queue would: by the rank of the
parent, then by the order of its edges.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.catalog import Catalog
from ..plans.lineage import cut

MAX_DEPTH = 20


def _arcs(edges: DataFrame, kinds: Iterable[str] | str | None, reverse: bool = False) -> DataFrame:
    """(at, to, kind, provenance, edge_seq)."""
    if kinds:
        edges = edges.where(F.col("kind").isin([kinds] if isinstance(kinds, str) else list(kinds)))
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("at"), F.col(b).alias("to"), "kind", "provenance", F.col("seq").alias("edge_seq"))


#: Parents of a level whose counts one task sums up.
RUN = 1 << 16


def search(edges: DataFrame, start: str, kinds=None, max_hops: int | None = 5, reverse: bool = False, until: str | None = None, most: int | None = None) -> DataFrame:
    """(id, hops, rank, parent, kind, provenance): the breadth-first tree from ``start``, which is in it with 0 hops.

    ``rank`` is the order in which a queue would reach the nodes. Stops at
    ``until`` if that is given, or after the level with which there are
    ``most`` nodes; without ``max_hops`` it goes on to the end.
    """
    spark = edges.sparkSession
    arcs = _arcs(edges, kinds, reverse)
    tree = spark.createDataFrame([(start, 0, 1, None, None, None)], "id string, hops int, rank long, parent string, kind string, provenance string")
    level = tree
    for hop in count(1) if max_hops is None else range(1, max_hops + 1):
        steps = level.select(F.col("id").alias("at"), F.col("rank").alias("parent_rank")).join(arcs, "at")
        new = steps.join(tree.select(F.col("id").alias("to")), "to", "left_anti")
        # of several ways to a node the earliest counts: one aggregation, no sort
        best = new.groupBy("to").agg(F.min_by(F.struct("at", "kind", "provenance", "parent_rank", "edge_seq"), F.struct("parent_rank", "edge_seq")).alias("b"))
        level = best.select(
            F.col("to").alias("id"), F.lit(hop).alias("hops"), F.col("b.at").alias("parent"), F.col("b.kind").alias("kind"),
            F.col("b.provenance").alias("provenance"), F.col("b.parent_rank").alias("_pr"), F.col("b.edge_seq").alias("_es"),
        )
        level = _ranked(level)
        if level.isEmpty():
            break
        tree = cut(tree.unionByName(level))
        if until is not None and not level.where(F.col("id") == until).isEmpty():
            break
        if most is not None and tree.count() >= most:
            break
    return tree


def _ranked(level: DataFrame) -> DataFrame:
    """Dense ranks of a level in queue order.

    Counts by parent give the bases, summed in two steps: within runs of
    parents, whose ranks are dense, and over the runs. No task holds the level
    or all its parents.
    """
    per = level.groupBy("_pr").agg(F.count(F.lit(1)).alias("n")).withColumn("run", F.floor(F.col("_pr") / RUN))
    runs = per.groupBy("run").agg(F.sum("n").alias("m"))  # a row for so many parents
    before = runs.select("run", (F.sum("m").over(Window.orderBy("run")) - F.col("m")).alias("before"))
    inner = F.sum("n").over(Window.partitionBy("run").orderBy("_pr")) - F.col("n")
    base = per.withColumn("inner", inner).join(before, "run").select("_pr", (F.col("inner") + F.col("before")).alias("base"))
    within = F.row_number().over(Window.partitionBy("_pr").orderBy("_es", "id"))
    out = level.withColumn("_in", within).join(base, "_pr")
    return cut(out.select("id", "hops", (F.col("base") + F.col("_in")).alias("rank"), "parent", "kind", "provenance"))


def reachable(edges: DataFrame, start: str, via=None, max_hops: int = 5) -> DataFrame:
    """(id, hops) of nodes reached in 1 to ``max_hops`` steps; the start is not among them."""
    arcs = _arcs(edges, via).select("at", "to").distinct()
    seen = edges.sparkSession.createDataFrame([(start, 0)], "id string, hops int")
    level = seen
    for hop in range(1, max_hops + 1):
        nxt = level.join(arcs, level["id"] == arcs["at"]).select(F.col("to").alias("id")).distinct()
        level = cut(nxt.join(seen, "id", "left_anti").withColumn("hops", F.lit(hop)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen.where(F.col("hops") > 0)


def reachable_sql(edges_view: str, start: str, max_hops: int = 5) -> str:
    """The same as one recursive query, for graphs that a session can hold."""
    quoted = start.replace("'", "''")
    return f"""
WITH RECURSIVE r(id, hops) AS (
  SELECT '{quoted}', 0 UNION ALL
  SELECT e.dst, r.hops + 1 FROM r JOIN {edges_view} e ON e.src = r.id WHERE r.hops < {max_hops})
SELECT id, min(hops) AS hops FROM r WHERE id <> '{quoted}' GROUP BY id"""


def meet_in_the_middle(edges: DataFrame, start: str, end: str, via=None, max_hops: int = 5) -> tuple[list[DataFrame], list[DataFrame]] | None:
    """Levels (id) of nodes by their distance from ``start``, and to ``end``, up to where they meet; None if they do not within ``max_hops``.

    The frontier with fewer nodes goes on. The last levels of both sides share
    the nodes in the middle of the shortest paths.
    """
    spark = edges.sparkSession
    one = lambda node: spark.createDataFrame([(node,)], "id string")
    arcs = [_arcs(edges, via, reverse).select("at", "to").distinct() for reverse in (False, True)]
    levels, seen, sizes = ([one(start)], [one(end)]), [one(start), one(end)], [1, 1]
    for _ in range(max_hops):
        side = 0 if sizes[0] <= sizes[1] else 1
        steps = levels[side][-1].select(F.col("id").alias("at")).join(arcs[side], "at").select(F.col("to").alias("id")).distinct()
        level = cut(steps.join(seen[side], "id", "left_anti"))
        sizes[side] = level.count()
        if not sizes[side]:
            return None
        levels[side].append(level)
        seen[side] = seen[side].unionByName(level)
        if not level.join(levels[1 - side][-1], "id", "left_semi").isEmpty():
            return levels
    return None


def find_path(edges: DataFrame, start: str, end: str, via=None, max_hops: int = 5) -> dict:
    """The shortest path: found, cost (-1 if none) and hops {from, to, via, provenance}.

    Of several it is the one that a queue finds first: at each node the
    earliest edge that leads on in the steps that are left. The path is short,
    so it is followed edge by edge.
    """
    if start == end:
        return {"found": True, "cost": 0, "hops": []}
    met = meet_in_the_middle(edges, start, end, via, max_hops)
    if met is None:
        return {"found": False, "cost": -1, "hops": []}
    forward, backward = met
    arcs = _arcs(edges, via)
    # nodes of the forward levels from which the middle is reached in time
    ahead = [cut(forward[-1].join(backward[-1], "id", "left_semi"))]
    for level in forward[-2:0:-1]:
        before = arcs.join(ahead[0].select(F.col("id").alias("to")), "to", "left_semi").select(F.col("at").alias("id"))
        ahead.insert(0, cut(level.join(before, "id", "left_semi")))
    # a side that never moved is the middle itself
    ahead = (ahead if len(forward) > 1 else []) + backward[-2::-1]
    hops, at = [], start
    for level in ahead:
        out = arcs.where(F.col("at") == at).join(level.select(F.col("id").alias("to")), "to", "left_semi")
        row = out.orderBy("edge_seq", "to").first()
        hops.append({"from": at, "to": row["to"], "via": row["kind"], "provenance": row["provenance"]})
        at = row["to"]
    return {"found": True, "cost": len(hops), "hops": hops}


def find_ax_path(catalog: Catalog, start: str, end: str, via=None, max_hops: int = 5) -> dict:
    """A path between two elements; both must exist."""
    known = catalog.ax.where(F.col("id").isin(start, end)).select("id").distinct().count()
    return find_path(catalog.edges, start, end, via, max_hops) if known == len({start, end}) else {"found": False, "cost": -1, "hops": []}


def find_page_path(catalog: Catalog, start: str, end: str, max_hops: int = 20) -> dict:
    return find_path(catalog.edges, start, end, "nav:child-of", max_hops)


def find_state_path(catalog: Catalog, start: str, end: str, max_hops: int = 20) -> dict:
    return find_path(catalog.edges, start, end, "state:successor", max_hops)


def _depth(depth) -> int:
    return max(0, min(MAX_DEPTH, int(depth // 1))) if depth is not None else 5


# ``child-of`` edges lead from the parent to its children


def children(nodes: DataFrame, edges: DataFrame, node: str, kind: str) -> DataFrame:
    e = edges.where((F.col("src") == node) & (F.col("kind") == kind)).select(F.col("dst").alias("id"), F.col("seq").alias("edge_seq"))
    return e.join(nodes, "id").orderBy("edge_seq")


def parent(nodes: DataFrame, edges: DataFrame, node: str, kind: str) -> DataFrame:
    e = edges.where((F.col("dst") == node) & (F.col("kind") == kind)).orderBy("seq").limit(1).select(F.col("src").alias("id"))
    return e.join(nodes, "id")


def descendants(nodes: DataFrame, edges: DataFrame, node: str, kind: str, depth=5) -> DataFrame:
    """Nodes below, in breadth-first order, with ``hops`` and ``rank``."""
    tree = search(edges, node, kind, _depth(depth)).where("hops > 0").select("id", "hops", "rank")
    return tree.join(nodes, "id").orderBy("hops", "rank")


def ancestors(nodes: DataFrame, edges: DataFrame, node: str, kind: str, depth=5) -> DataFrame:
    tree = search(edges, node, kind, _depth(depth), reverse=True).where("hops > 0").select("id", "hops", "rank")
    return tree.join(nodes, "id").orderBy("hops", "rank")


def nav_links(catalog: Catalog, page: str) -> DataFrame:
    """Pages one navigation link away."""
    return children(catalog.pages, catalog.edges, page, "nav-link")


def _structures(catalog: Catalog, container: str, kinds: tuple[str, ...]) -> DataFrame:
    nav = catalog.nav.where((F.col("container_ax_id") == container) & F.col("kind").isin(*kinds)).withColumnsRenamed({"id": "nav_id", "name": "nav_name", "kind": "nav_kind", "seq": "nav_seq"})
    members = nav.select("nav_id", "nav_kind", "nav_name", "nav_seq", F.posexplode("member_ax_ids").alias("pos", "id"))
    return members.join(catalog.ax, "id").orderBy("nav_seq", "pos")


def breadcrumbs(catalog: Catalog, container: str) -> DataFrame:
    """The trail's members, in order."""
    return _structures(catalog, container, ("breadcrumb",))


def menu(catalog: Catalog, container: str) -> DataFrame:
    """Members of the menus, menubars and tablists of a container."""
    return _structures(catalog, container, ("menu", "menubar", "tablist"))


def tab_of(catalog: Catalog, tab: str) -> DataFrame:
    """Tablists that a tab belongs to."""
    e = catalog.edges.where((F.col("src") == tab) & (F.col("kind") == "tab-of")).select(F.col("dst").alias("id"), F.col("seq").alias("edge_seq"))
    return e.join(catalog.nav, "id").where("kind = 'tablist'").orderBy("edge_seq")


def state_neighbors(catalog: Catalog, state: str, relation: str) -> DataFrame:
    """Successors or predecessors of a state."""
    a, b = ("src", "dst") if relation == "successors" else ("dst", "src")
    e = catalog.edges.where((F.col(a) == state) & (F.col("kind") == "state:successor")).select(F.col(b).alias("id"), F.col("seq").alias("edge_seq"))
    return e.join(catalog.states, "id").orderBy("edge_seq")


def relate(catalog: Catalog, start: str, relation: str, target: str | None = None, depth=5, max_hops: int = 5, via=None):
    """The relation of a node: a DataFrame of nodes, or for ``path`` a path.

    Pages, elements and states are told apart by their ids, except for the
    relations that belong to one of them.
    """
    on_pages = {"nav-links": nav_links, "breadcrumbs": breadcrumbs, "menu": menu, "tab-of": tab_of}
    if relation in on_pages:
        return on_pages[relation](catalog, start)
    is_state = start.startswith("state:")
    if relation in ("successors", "predecessors"):
        return state_neighbors(catalog, start, relation)
    if relation == "reachable":
        kind, nodes = ("state:successor", catalog.states)
        return reachable(catalog.edges, start, kind, _depth(depth)).join(nodes, "id").orderBy("hops")
    if relation == "path":
        if is_state:
            return find_state_path(catalog, start, target, max_hops)
        return find_page_path(catalog, start, target, max_hops) if start.startswith("page:") else find_ax_path(catalog, start, target, via, max_hops)
    if is_state:
        return catalog.states.limit(0)  # states form no tree
    nodes, kind = (catalog.pages, "nav:child-of") if start.startswith("page:") else (catalog.ax, "a11y:child-of")
    if relation in ("children", "parent"):
        return {"children": children, "parent": parent}[relation](nodes, catalog.edges, start, kind)
    if relation in ("descendants", "ancestors"):
        return {"descendants": descendants, "ancestors": ancestors}[relation](nodes, catalog.edges, start, kind, depth)
    raise ValueError(f"unknown relation: {relation}")


def explain(catalog: Catalog, node: str, depth: int = 2) -> dict[str, DataFrame]:
    """What surrounds an element: edges forward from each node within reach, edges into it, its page, that page's capabilities and nav elements."""
    near = search(catalog.edges, node, None, max(0, depth - 1)).select(F.col("id").alias("at"), "hops", "rank")
    arcs = _arcs(catalog.edges, None)
    targets = catalog.ax.select(F.col("id").alias("to"))
    inner = near.join(catalog.ax.select(F.col("id").alias("at")), "at", "left_semi") if depth > 0 else near.limit(0)
    forward = inner.join(arcs, "at").join(targets, "to", "left_semi").orderBy("hops", "rank", "edge_seq")
    backward = _arcs(catalog.edges, None, reverse=True).where(F.col("at") == node).join(targets, "to", "left_semi").orderBy("edge_seq")
    page = catalog.ax.where(F.col("id") == node).select(F.col("page_id").alias("_page"))
    on = lambda df, c: df.join(page, F.col(c) == F.col("_page"), "left_semi")
    return {"forward": forward, "backward": backward, "page": on(catalog.pages, "id"), "capabilities": on(catalog.capabilities, "page_id"), "nav": on(catalog.nav, "page_id")}
