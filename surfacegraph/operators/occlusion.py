"""Occlusion of visual nodes: paint order, clipping and uncovered area.

Candidates come from the same cells of a page. The covered area of a node is
that of a union of rectangles: regions with many covers are quartered until one
cover hides them or few are left, and those are measured by coordinate
compression: the covers' edges cut the region into strips, and each strip's
covered length is a merge of intervals. If only counts and areas are asked for,
no pairs are made: see :mod:`cover`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.css import styled
from ..functions.geometry import area, bottom, edges, intersection, rect, right
from ..functions.js import is_, js_round, one_of, parse_float, to_fixed, yes
from ..plans.lineage import cut, stored
from . import cover, quadtree
from .labels import climb, intervals
from .quadtree import meet

#: Fixed value: below this visible share a node counts as occluded.
LEAST_VISIBLE = 0.5


def paint_rank(style_map: Column, stacking: Column, z: Column) -> Column:
    """struct(z, context, floating): a node paints above another if it compares greater.

    ``z`` is the stacking context's index (null for auto); a floating node is
    above only at equal z and context.
    """
    value = F.coalesce(z.cast("double"), parse_float(style_map["zIndex"]), F.lit(0.0))
    return F.struct(
        value.alias("z"), yes(stacking).cast("int").alias("context"), one_of(style_map["position"], ("fixed", "sticky")).cast("int").alias("floating")
    )


def can_occlude(style_map: Column, has_children: Column) -> Column:
    """Paints something over what is below it."""
    hidden = is_(style_map["display"], "none") | is_(style_map["visibility"], "hidden")
    faint = F.coalesce(parse_float(style_map["opacity"]) < 0.1, F.lit(False))
    clear = one_of(style_map["backgroundColor"], ("transparent", "rgba(0, 0, 0, 0)"))
    border = styled(style_map, "border") & ~F.coalesce(F.startswith(style_map["border"], F.lit("0px")), F.lit(False))
    return F.when(style_map.isNull(), True).otherwise(~hidden & ~faint & (~clear | border | styled(style_map, "box-shadow") | yes(has_children)))


def ancestors(nodes: DataFrame) -> DataFrame:
    """(id, ancestor, depth) along layout parents. ``nodes``: id, parent.

    Walks up level by level to the roots; raises on a cycle of parents.
    """
    level = nodes.where("parent is not null").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    up = nodes.select(F.col("id").alias("ancestor"), F.col("parent").alias("next"))
    out, depth = level, 1
    while True:
        # a node that is its own ancestor never leaves the walk
        if not level.where("id = ancestor").isEmpty():
            raise ValueError("layout parents form a cycle")
        depth += 1
        level = level.join(up, "ancestor").where("next is not null").select("id", F.col("next").alias("ancestor"), F.lit(depth).alias("depth"))
        level = cut(level)
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def ranked(nodes: DataFrame) -> DataFrame:
    """``nodes`` without what occlusion does not need: page_id, id, parent, rect, padding_box, clips, rank, occludes.

    Styles are wide, and rows are sorted and joined several times after.
    """
    s = F.col("style")
    rank = paint_rank(s, F.col("is_stacking"), F.col("z")).alias("rank")
    return nodes.select("page_id", "id", "parent", "rect", "padding_box", _clips().alias("clips"), rank, can_occlude(s, F.col("has_children")).alias("occludes"))


def _clips() -> Column:
    """Scrolls, or has overflow that clips."""
    return yes("is_scroll") | one_of(F.col("style")["overflow"], ("hidden", "scroll", "auto"))


def clipped(nodes: DataFrame, viewport_w: float = 1440, viewport_h: float = 900) -> DataFrame:
    """``nodes`` with ``clip``: what viewport and clipping ancestors leave (null if nothing).

    ``nodes``: page_id, id, parent, rect, padding_box (or null), and style and is_scroll, or ``clips`` of :func:`ranked`.
    Clipping by several boxes is clipping by their intersection, so bounds are
    combined along the parents in any order: see :func:`labels.climb`.
    """
    clips = F.col("clips") if "clips" in nodes.columns else _clips()
    box = F.coalesce("padding_box", "rect")
    bounds = {"x0": box["x"], "y0": box["y"], "x1": box["x"] + box["w"], "y1": box["y"] + box["h"]}
    own = nodes.select(F.col("id").alias("up"), *[F.when(clips, v).alias(c) for c, v in bounds.items()])
    # a node starts with the bounds of its parent: its own box does not clip it
    first = nodes.where("parent is not null").select("id", F.col("parent").alias("up")).join(own, "up")
    bound = climb(first.select("id", "up", *bounds), {"x0": F.greatest, "y0": F.greatest, "x1": F.least, "y1": F.least}).drop("up")
    r = F.col("rect")
    view = intersection(r, rect(F.lit(0), F.lit(0), F.lit(viewport_w), F.lit(viewport_h)))
    limit = rect("x0", "y0", F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    # nodes without a parent need no partner
    joined = nodes.where("parent is not null").join(bound, "id", "left").select(*nodes.columns, *bounds)
    roots = nodes.where("parent is null").select(*nodes.columns, *[F.lit(None).cast("double").alias(c) for c in bounds])
    # what is outside the viewport stays so, whatever clips it
    clip = F.when(F.col("x0").isNull(), view).when(view.isNotNull(), intersection(view, limit))
    return roots.unionByName(joined).withColumn("clip", F.when((r["w"] > 0) & (r["h"] > 0), clip)).drop("x0", "y0", "x1", "y1")


def covered_area(covers: np.ndarray) -> float:
    """Area of the union of rectangles (x, y, w, h)."""
    xs = np.unique(np.r_[covers[:, 0], covers[:, 0] + covers[:, 2]])
    total = 0.0
    for x0, x1 in zip(xs[:-1], xs[1:]):
        here = covers[(covers[:, 0] <= x0) & (covers[:, 0] + covers[:, 2] >= x1)]
        if len(here):
            here = here[np.argsort(here[:, 1])]
            top, end = here[:, 1], np.maximum.accumulate(here[:, 1] + here[:, 3])
            gap = np.maximum(0, top[1:] - end[:-1]).sum()
            total += (x1 - x0) * (end[-1] - top[0] - gap)
    return float(total)


#: Covers of a region that are measured at once; a region with more is quartered.
MOST_COVERS = 256
#: Times that a region is quartered; what is left then is measured however many covers it has.
QUARTERINGS = 12


def covered_areas(covers: DataFrame, most: int = MOST_COVERS) -> DataFrame:
    """(id, covered): the area of ``clip`` under the union of the covers, of ``covers`` (id, clip, cover).

    A region is done as soon as one cover hides all of it, or when it has few
    covers, which are measured in one sweep. Others are quartered, and covers go
    to the quarters that they reach, so no list of all covers of a node is made.
    """
    key = ["id", "region"]
    rows = covers.select("id", F.col("clip").alias("region"), intersection(F.col("clip"), F.col("cover")).alias("cover")).where("cover is not null")
    done = None
    g, c = F.col("region"), F.col("cover")
    for turn in range(QUARTERINGS + 1):
        rows = cut(rows.distinct())
        whole = (c["x"] <= g["x"]) & (c["y"] <= g["y"]) & (right(c) >= right(g)) & (bottom(c) >= bottom(g))
        held = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(whole).alias("hidden"))
        hidden = held.where("hidden").select("id", area(g).alias("covered"))
        few = F.lit(True) if turn == QUARTERINGS else F.col("n") <= most
        lists = rows.join(held.where(~F.col("hidden") & few).select(key), key).groupBy(key).agg(F.collect_list("cover").alias("covers"))
        measured = hidden.unionAll(lists.select("id", "covers").mapInArrow(_measure, "id string, covered double"))
        done = measured if done is None else done.unionAll(measured)
        crowded = held.where(~F.col("hidden") & ~few).select(key)
        if turn == QUARTERINGS or crowded.isEmpty():
            return done.groupBy("id").agg(F.sum("covered").alias("covered"))
        half_w, half_h = g["w"] / 2, g["h"] / 2
        quarters = F.array(*[rect(g["x"] + i * half_w, g["y"] + j * half_h, half_w, half_h) for i in (0, 1) for j in (0, 1)])
        parts = rows.join(crowded, key).select("id", F.explode(quarters).alias("region"), "cover")
        rows = parts.withColumn("cover", intersection(g, c)).where("cover is not null")


def _measure(batches):
    """Areas under lists of rectangles, read from the columns of the lists."""
    for b in batches:
        lists = b.column("covers")
        flat = lists.flatten()
        boxes = np.column_stack([flat.field(k).to_numpy(zero_copy_only=False) for k in range(4)]) if len(flat) else np.empty((0, 4))
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).tolist()
        found = [covered_area(boxes[a:z]) for a, z in zip([0, *ends[:-1]], ends, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.float64())], names=["id", "covered"])


def occluders(nodes: DataFrame, exempt: Column | None = None) -> DataFrame:
    """(id, other, cover): nodes painted above another, with the common rectangle.

    ``nodes``: page_id, id, rect, clip, rank, occludes, and perhaps a number
    ``pre``. Pairs for which ``exempt`` holds, of the columns of the lower node
    and ``o_pre`` of the upper, are left out.
    """
    def extended(df: DataFrame, name: str) -> DataFrame:
        r = F.col(name)
        return df.where(r.isNotNull() & (r["w"] > 0) & (r["h"] > 0))

    def sides(name: str, prefix: str) -> list[Column]:
        # z comes first, then the stacking context, then whether it floats
        rank = F.col("rank")
        return [*edges(F.col(name), prefix), rank["z"].alias(f"{prefix}_z"), (rank["context"] * 2 + rank["floating"]).alias(f"{prefix}_tier")]

    labelled = [c for c in ("pre", "last") if c in nodes.columns]
    low = extended(nodes, "clip").select("page_id", "id", "clip", *sides("clip", "a"), *labelled)
    upper = [F.col("id").alias("other"), F.col("rect").alias("o_rect"), *sides("rect", "b")]
    high = extended(nodes.where("occludes"), "rect").select("page_id", *upper, *[F.col(c).alias("o_pre") for c in labelled[:1]])
    c = F.col
    above = (c("b_z") > c("a_z")) | ((c("b_z") == c("a_z")) & (c("b_tier") > c("a_tier")))
    # compared a pair: plain numbers, the rectangle only of pairs that count
    common = [F.least(c(f"a_{k}1"), c(f"b_{k}1")) > F.greatest(c(f"a_{k}0"), c(f"b_{k}0")) for k in "xy"]
    return (
        meet(low, high, "clip", "o_rect")
        .where(common[0] & common[1] & above & (c("id") != c("other")) & (F.lit(True) if exempt is None else ~exempt))
        .select("id", "other", intersection(c("clip"), c("o_rect")).alias("cover"))
    )


def counted(base: DataFrame, viewport_w: float = 1440, viewport_h: float = 900, most: int = quadtree.MOST) -> DataFrame:
    """(id, occluders, covered): how many nodes paint above each, and how much of its ``clip`` they hide; nodes that nothing hides may be missing.

    ``base``: page_id, id, parent, rect, rank, occludes, clip. Nodes go to the
    cells that they reach, in which all are measured at once by :mod:`cover`;
    counts and areas of the cells add up.
    """
    # only what is in the viewport can be hidden, so only what is in it matters above
    seen = base.withColumn("view", intersection(F.col("rect"), rect(F.lit(0), F.lit(0), F.lit(viewport_w), F.lit(viewport_h))))
    # only trees of several nodes have subtrees to leave out
    kids = base.where("parent is not null").select("id", "page_id", "parent")
    heads = base.join(kids.select(F.col("parent").alias("id")).distinct(), "id", "left_semi").where("parent is null").select("id", "page_id", "parent")
    pre, last = F.lit(None).cast("long").alias("pre"), F.lit(None).cast("long").alias("last")
    if kids.isEmpty():
        named = seen.select("*", pre, last)
    else:
        within = intervals(kids.unionByName(heads).withColumn("order", F.lit(0))).select("id", "pre", "last")
        named = seen.join(within, "id", "left")
    r, rank = F.col("rect"), F.col("rank")
    own = [F.when(F.col("clip").isNotNull(), e).alias(f"a_{k}") for e, k in zip(edges(F.col("clip"), "a"), ("x0", "y0", "x1", "y1"), strict=True)]
    tier = (rank["context"] * 2 + rank["floating"]).cast("int").alias("tier")
    rows = named.where(F.col("page_id").isNotNull() & F.col("view").isNotNull() & (r["w"] > 0) & (r["h"] > 0))
    rows = rows.select("page_id", "id", "view", *edges(F.col("view"), "b"), *own, rank["z"].alias("z"), tier, "occludes", "pre", "last")
    corner = F.col("view")
    split = cut(quadtree.split_cells(rows.select("page_id", corner["x"].alias("x"), corner["y"].alias("y")), most))
    placed = quadtree.assign(rows, corner, split).drop("view", "q_from")
    grid = (quadtree.SIDE, quadtree.STEPS, quadtree.BITS, quadtree.LIMIT)
    found = placed.groupBy("page_id", *quadtree.CELL).applyInArrow(lambda key, t: cover.measured(key, t, *grid), cover.FOUND)
    # rows of one id are alike: they are counted each, and covered once
    return found.groupBy("id").agg(F.sum("n").cast("int").alias("occluders"), (F.sum("covered") / F.sum("own")).alias("covered"))


def occlusion(nodes: DataFrame, viewport_w: float = 1440, viewport_h: float = 900, listed: bool = True) -> DataFrame:
    """(id, visible_ratio, is_occluded, occluded_by, clip, is_offscreen, occluded_area, visible_area).

    ``nodes``: page_id, id, parent, rect, padding_box, style, is_scroll,
    is_stacking, z, has_children. If not ``listed``, ``occluders`` has the length
    of ``occluded_by`` in its place, and pairs of nodes are neither listed nor stored.
    """
    base = stored(clipped(ranked(nodes), viewport_w, viewport_h).select("page_id", "id", "parent", "rect", "rank", "occludes", "clip"))
    if listed:
        # a node's subtree does not occlude it
        named = intervals(base.select("page_id", "id", "parent", F.lit(0).alias("order"))).select("id", "pre", "last")
        above = cut(occluders(base.join(named, "id"), F.col("o_pre").between(F.col("pre"), F.col("last"))))
        name, none = "occluded_by", F.array().cast("array<string>")
        by = above.groupBy("id").agg(F.sort_array(F.collect_list("other")).alias(name))
        got = base.join(by, "id", "left").join(covered_areas(above.join(base.select("id", "clip"), "id")), "id", "left")
    else:
        name, none = "occluders", F.lit(0)
        got = base.join(counted(base, viewport_w, viewport_h), "id", "left")
    got = got.select("id", area(F.col("rect")).alias("area"), "clip", name, F.coalesce("covered", F.lit(0.0)).alias("covered"))
    free = F.when(F.col("clip").isNull(), 0.0).otherwise(area(F.col("clip")) - F.col("covered"))
    ratio = F.when(F.col("area") > 0, to_fixed(F.greatest(F.lit(0.0), F.least(F.lit(1.0), free / F.col("area"))), 4)).otherwise(0.0)
    return got.select(
        "id",
        ratio.alias("visible_ratio"),
        (ratio < LEAST_VISIBLE).alias("is_occluded"),
        F.coalesce(name, none).alias(name),
        "clip",
        F.col("clip").isNull().alias("is_offscreen"),
        js_round(F.greatest(F.lit(0.0), F.col("area") - js_round(free))).alias("occluded_area"),
        js_round(free).alias("visible_area"),
    )


def occluded_nodes(visual: DataFrame, page_id: str | None = None, min_ratio: float = LEAST_VISIBLE) -> DataFrame:
    """Visual nodes with occlusion data that are occluded or show less than ``min_ratio``."""
    df = visual if page_id is None else visual.where(F.col("page_id") == page_id)
    o = F.col("occlusion")
    return df.where(o.isNotNull() & (yes(o["is_occluded"]) | F.coalesce(o["visible_ratio"] < min_ratio, F.lit(False))))
