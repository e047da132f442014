"""Layout facts of single visual nodes, and of siblings: box model, stacking,
scrolling, container types, tethers, alignment, prominence, responsive hints
and component groups.

Visual tables have ``style`` (a map of computed styles) and ``rect``. Facts of
single nodes are column expressions, so they fuse with the scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.css import style, styled
from ..functions.geometry import rect, union_all
from ..functions.js import col, includes, is_, js_round, number_or, one_of, parse_float, parse_int, truthy
from ..plans.lineage import cut
from ..plans.prefix import running_sum
from .quadtree import grouped

# Fixed values of the rules.
ALIGN = 2
CENTRE = 4
PROXIMITY = 24
#: Boxes of a page, or of a block of one, among which those within another are found at once.
FOLD = 4096
SECTION_TAGS = ("section", "article", "main", "aside", "nav", "header", "footer")
SIDES = ("top", "right", "bottom", "left")
FLUID = ("%", "fr", "minmax", "clamp", "calc(", "auto", "min-content", "max-content")
FLOATING = ("fixed", "absolute", "sticky")


def edges_of(s: Column, pattern: str) -> dict[str, Column]:
    return {side: number_or(style(s, pattern.format(side)), 0) for side in SIDES}


def box_model(r: Column, s: Column) -> Column:
    """Content, padding, border and margin boxes."""
    margin, border, padding = (edges_of(s, p) for p in ("margin-{}", "border-{}-width", "padding-{}"))

    def shrink(b: dict, e: dict) -> dict:
        return {
            "x": b["x"] + e["left"], "y": b["y"] + e["top"],
            "w": F.greatest(F.lit(0.0), b["w"] - e["left"] - e["right"]), "h": F.greatest(F.lit(0.0), b["h"] - e["top"] - e["bottom"]),
        }

    outer = {k: r[k] for k in "xywh"}
    pad = shrink(outer, border)
    content = shrink(pad, padding)
    around = {
        "x": outer["x"] - margin["left"], "y": outer["y"] - margin["top"],
        "w": outer["w"] + margin["left"] + margin["right"], "h": outer["h"] + margin["top"] + margin["bottom"],
    }
    boxes = [rect(**b).alias(n) for n, b in (("content", content), ("padding_box", pad), ("border_box", outer), ("margin_box", around))]
    widths = [F.struct(*[v.alias(k) for k, v in e.items()]).alias(n) for n, e in (("padding", padding), ("border", border), ("margin", margin))]
    return F.struct(*boxes, *widths, F.coalesce(style(s, "box-sizing"), F.lit("content-box")).alias("box_sizing"))


def stacking_context(s: Column, is_root: Column | None = None, parent: Column | None = None) -> Column:
    """Whether the styles make a stacking context, its z-index (null: auto) and the reasons."""
    position = F.coalesce(s["position"], F.lit("static"))
    z = parse_int(style(s, "z-index"))
    opacity = parse_float(F.coalesce(s["opacity"], F.lit("1")))
    contain, change = F.coalesce(s["contain"], F.lit("")), F.coalesce(style(s, "will-change"), F.lit(""))
    blend = style(s, "mix-blend-mode")

    def any_of(c: Column, parts) -> Column:
        out = F.lit(False)
        for p in parts:
            out = out | F.contains(c, F.lit(p))
        return out

    reasons = [
        F.when(F.coalesce(is_root, F.lit(False)) if is_root is not None else F.lit(False), F.lit("root")),
        F.when(position.isin("relative", "absolute") & z.isNotNull(), F.concat(F.lit("position:"), position, F.lit(" z-index:"), z.cast("string"))),
        F.when(position.isin("fixed", "sticky"), F.concat(F.lit("position:"), position)),
        F.when(opacity < 1, F.concat(F.lit("opacity:"), F.when(opacity == F.floor(opacity), opacity.cast("long").cast("string")).otherwise(opacity.cast("string")))),
        F.when(styled(s, "transform"), F.lit("transform")),
        F.when(styled(s, "filter"), F.lit("filter")),
        F.when(s["isolation"] == "isolate", F.lit("isolation:isolate")),
        F.when(truthy(blend) & (blend != "normal"), F.concat(F.lit("mix-blend-mode:"), blend)),
        F.when(any_of(contain, ("paint", "layout", "strict", "content")), F.concat(F.lit("contain:"), contain)),
        F.when(styled(s, "clip-path"), F.lit("clip-path")),
        F.when(any_of(change, ("transform", "opacity", "filter")), F.concat(F.lit("will-change:"), change)),
    ]
    found = F.filter(F.array(*reasons), lambda x: x.isNotNull())
    return F.struct(
        (F.size(found) > 0).alias("is_stacking_context"), z.alias("z_index"), found.alias("reasons"),
        (parent if parent is not None else F.lit(None).cast("string")).alias("parent_ax_id"),
    )


def scroll_context(s: Column, scroll_w, scroll_h, client_w, client_h) -> Column:
    """Scrolling and clipping from styles and scroll metrics."""
    plain = F.coalesce(s["overflow"], F.lit("visible"))
    ox, oy = F.coalesce(style(s, "overflow-x"), plain), F.coalesce(style(s, "overflow-y"), plain)
    can_x, can_y = col(scroll_w) > col(client_w) + 1, col(scroll_h) > col(client_h) + 1
    clip = styled(s, "clip-path")
    return F.struct(
        (ox.isin("scroll", "auto") | oy.isin("scroll", "auto") | can_x | can_y).alias("is_scroll_container"),
        can_x.alias("can_scroll_x"), can_y.alias("can_scroll_y"),
        ((ox != "visible") | (oy != "visible") | clip).alias("is_clipped"),
        ox.alias("overflow_x"), oy.alias("overflow_y"), F.when(clip, style(s, "clip-path")).alias("clip_path"),
    )


def container_type(r: Column, s: Column, tag, element_id, class_name, child_count, is_scroll) -> Column:
    """Kind of visual container: the first rule that fits."""
    display = F.coalesce(s["display"], F.lit("block"))
    tag = F.lower(F.coalesce(col(tag), F.lit("div")))
    back = s["backgroundColor"]
    has_back = truthy(back) & ~one_of(back, ("transparent", "rgba(0, 0, 0, 0)"))
    widths = edges_of(s, "border-{}-width")
    bordered = (widths["top"] > 0) | (widths["right"] > 0) | (widths["bottom"] > 0) | (widths["left"] > 0)
    bordered = bordered & ~is_(F.coalesce(s["borderStyle"], s["border-style"]), "none")
    shadow, rounded = styled(s, "box-shadow"), number_or(style(s, "border-radius"), 0) > 0

    def named(word: str) -> Column:
        return includes(F.lower(col(class_name)), word) | includes(F.lower(col(element_id)), word)

    hero = named("hero") | named("banner") | ((tag == "header") & (r["h"] > 150))
    card = named("card") | (bordered & rounded) | (shadow & (has_back | bordered))
    return (
        F.when(display.isin("grid", "inline-grid"), "grid")
        .when(display.isin("flex", "inline-flex"), "flex")
        .when(hero & ((r["w"] > 200) | (r["h"] > 100)), "hero")
        .when(card & (r["w"] > 80) & (r["h"] > 60), "card")
        .when(tag.isin(*SECTION_TAGS), "section")
        .when(F.coalesce(col(is_scroll), F.lit(False)), "scroll")
        .when((has_back | styled(s, "backgroundImage") | bordered | shadow) & (r["w"] > 40) & (r["h"] > 40), "container")
        .when((F.coalesce(col(child_count), F.lit(0)) >= 2) & (r["w"] > 50) & (r["h"] > 20), "wrapper")
        .otherwise("none")
    )


def render_bounds(r: Column, layout: Column, s: Column) -> Column:
    moved = styled(s, "transform")
    return F.struct(r.alias("transformed"), layout.alias("layout"), moved.alias("has_transform"), F.when(moved, s["transform"]).alias("transform"))


def layout_parents(elements: DataFrame) -> DataFrame:
    """(ax_id, layout_parent): the parent, or for a positioned element its nearest positioned ancestor.

    ``elements``: page_id, ax_id, parent_ax_id, style. Walks up level by level.
    """
    position = F.coalesce(F.col("style")["position"], F.lit("static"))
    base = elements.select("ax_id", "parent_ax_id", position.alias("position"))
    still = base.where(~F.col("position").isin(*FLOATING)).select("ax_id", F.col("parent_ax_id").alias("layout_parent"))
    up = base.select(F.col("ax_id").alias("at"), F.col("parent_ax_id").alias("next"), F.col("position").alias("at_position"))
    walk = base.where(F.col("position").isin(*FLOATING)).select("ax_id", F.col("parent_ax_id").alias("at"))
    out = still
    while True:
        seen = walk.join(up, "at", "left")
        stop = F.col("at_position").isNull() | (F.col("at_position") != "static") | F.col("next").isNull()
        ends = seen.where(stop).select("ax_id", F.when(F.col("at_position") != "static", F.col("at")).alias("layout_parent"))
        out = out.unionByName(ends)
        walk = cut(seen.where(~stop).select("ax_id", F.col("next").alias("at")))
        if walk.isEmpty():
            return out


def siblings(nodes: DataFrame) -> DataFrame:
    """``nodes`` with siblings_before and siblings_after in visual order (y, x, seq).

    ``nodes``: page_id, id, parent, rect, seq.
    """
    w = Window.partitionBy("page_id", "parent").orderBy(F.col("rect.y"), F.col("rect.x"), "seq")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    return nodes.withColumn("siblings_before", F.collect_list("id").over(before)).withColumn("siblings_after", F.collect_list("id").over(after))


def sibling_places(nodes: DataFrame) -> DataFrame:
    """(page_id, parent, id, y, x, seq, place): how many siblings come before a node in visual order; a row a node.

    Says what :func:`siblings` says without lists, whose sizes add up to the
    square of a parent's children. Children of one parent are sorted over many
    tasks. Nodes without a parent are siblings within their page; of nodes in
    one place with one ``seq`` the id decides.
    """
    rows = nodes.select("page_id", "parent", "id", F.col("rect.y").alias("y"), F.col("rect.x").alias("x"), "seq")
    return running_sum(rows, ["page_id", "parent"], ["y", "x", "seq", "id"], F.lit(1).cast("long"), "place")


def sibling_ranks(nodes: DataFrame) -> DataFrame:
    """(id, before, after, first): how many siblings come before and after a node in visual order, and which is the first of all.

    The sizes and the heads of the lists of :func:`siblings`, in a row a node
    of fixed size. ``nodes``: as there.
    """
    key = ["page_id", "parent"]
    places = sibling_places(nodes)
    # a row a parent
    groups = places.groupBy(*[F.col(k).alias(f"g_{k}") for k in key]).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("place") == 0, F.col("id"))).alias("first"))
    same = F.col("page_id").eqNullSafe(F.col("g_page_id")) & F.col("parent").eqNullSafe(F.col("g_parent"))
    return places.join(groups, same).select("id", F.col("place").cast("int").alias("before"), (F.col("n") - 1 - F.col("place")).cast("int").alias("after"), "first")


def siblings_of(places: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, sibling, side, distance): the siblings of the nodes in ``asked(id)``, each with its side, before or after, and how many places away it is.

    ``places``: as from :func:`sibling_places`. Ids asked for twice count once; unknown ones have no rows.
    """
    own = places.join(asked.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("of"), F.col("page_id").alias("p"), F.col("parent").alias("q"), F.col("place").alias("own"))
    same = F.col("page_id").eqNullSafe(F.col("p")) & F.col("parent").eqNullSafe(F.col("q")) & (F.col("place") != F.col("own"))
    side = F.when(F.col("place") < F.col("own"), "before").otherwise("after")
    return places.join(own, same).select(F.col("of").alias("id"), F.col("id").alias("sibling"), side.alias("side"), F.abs(F.col("place") - F.col("own")).alias("distance"))


def tethers(elements: DataFrame) -> DataFrame:
    """(ax_id, parent, children, siblings_before, siblings_after, anchors) of every element.

    ``elements``: page_id, ax_id, parent_ax_id, rect, style, seq. An anchor name
    belongs to the last element that registers it; unresolved names are left out.
    """
    placed = elements.join(layout_parents(elements), "ax_id").select("page_id", F.col("ax_id").alias("id"), F.col("layout_parent").alias("parent"), "rect", "style", "seq")
    ordered = siblings(placed)
    children = placed.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "id"))), lambda c: c["id"]).alias("children"))

    def names(prop: str) -> Column:
        return F.filter(F.transform(F.split(F.coalesce(F.col("style")[prop], F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")

    registered = placed.select("page_id", F.explode(names("anchor-name")).alias("name"), "id", "seq").groupBy("page_id", "name").agg(F.max_by("id", "seq").alias("target"))
    wanted = placed.select("page_id", "id", F.posexplode(names("position-anchor")).alias("pos", "name"))
    anchors = wanted.join(registered, ["page_id", "name"]).groupBy("id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "name", "target"))), lambda a: F.struct(a["name"].alias("name"), a["target"].alias("target"))).alias("anchors")
    )
    empty = F.array().cast("array<string>")
    return (
        ordered.join(children, "id", "left")
        .join(anchors, "id", "left")
        .select(F.col("id").alias("ax_id"), "page_id", "parent", F.coalesce("children", empty).alias("children"), "siblings_before", "siblings_after", F.coalesce("anchors", F.array().cast("array<struct<name:string,target:string>>")).alias("anchors"))
    )


def alignments(nodes: DataFrame) -> DataFrame:
    """(page_id, src, dst, alignment) between siblings: the first kind that fits.

    ``nodes``: page_id, id, parent, rect. Siblings of one kind lie in one band
    of y or x, so pairs meet in bands and not all against all.
    """
    r = F.col("rect")
    wide = CENTRE + 1
    nodes = nodes.select("page_id", "parent", "id", "rect").distinct()

    def banded(key: Column, name: str) -> DataFrame:
        return nodes.select("page_id", "parent", "id", "rect", F.lit(name).alias("by"), F.floor(key / wide).alias("band"))

    all_ = banded(r["y"], "y").unionByName(banded(r["x"], "x")).unionByName(banded(r["x"] + r["w"] / 2, "c"))
    a = all_.select("page_id", "parent", "by", "band", F.col("id").alias("src"), F.col("rect").alias("a"))
    b = all_.select("page_id", "parent", "by", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("id").alias("dst"), F.col("rect").alias("b"))
    same = a["parent"].eqNullSafe(b["parent"]) & (a["page_id"] == b["page_id"]) & (a["by"] == b["by"]) & (a["band"] == b["band"])
    p, q = F.col("a"), F.col("b")
    kind = (
        F.when((F.abs(p["y"] - q["y"]) <= ALIGN) & (F.abs(p["h"] - q["h"]) <= ALIGN), "aligned-horizontally")
        .when((F.abs(p["x"] - q["x"]) <= ALIGN) & (F.abs(p["w"] - q["w"]) <= ALIGN), "aligned-vertically")
        .when(F.abs(p["x"] + p["w"] / 2 - q["x"] - q["w"] / 2) <= CENTRE, "centred-with")
    )
    # a pair has one kind and meets once in the bands of that kind, so none is there twice and pairs need no shuffle
    its = F.when(kind == "aligned-horizontally", "y").when(kind == "aligned-vertically", "x").when(kind == "centred-with", "c")
    return a.join(b, same & (F.col("src") != F.col("dst")) & (its == a["by"])).select(a["page_id"], "src", "dst", kind.alias("alignment"))


def _score(c: Column) -> Column:
    # greatest and least would skip a null
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), js_round(c))))


def prominence(s: Column) -> Column:
    """Scores from 0 to 100 for z-index, opacity, scale and font size, and flags."""
    z = parse_float(s["zIndex"])
    z_score = F.when(z.isNull() | (z < 0), 0.0).when(z <= 10, js_round(z / 10 * 60)).when(z <= 100, js_round(F.lit(60.0) + (z - 10) / 90 * 40)).otherwise(100.0)
    opacity = F.coalesce(_score((F.lit(1.0) - parse_float(s["opacity"])) * 100), F.lit(0.0))
    scale = parse_float(F.nullif(F.regexp_extract(s["transform"], r"scale\(([^)]+)\)", 1), F.lit("")))
    scaled = F.coalesce(_score((scale - 1) * 100), F.lit(0.0))
    font = F.coalesce(_score((parse_float(s["fontSize"]) - 8) / 16 * 100), F.lit(75.0))
    return F.struct(
        z_score.alias("z_index"), opacity.alias("opacity"), scaled.alias("transform"), font.alias("font_size"),
        one_of(F.trim(F.lower(s["position"])), FLOATING).alias("is_overlay"),
        one_of(F.trim(F.lower(s["cursor"])), ("pointer", "grab", "grabbing")).alias("is_interactive"),
        ((z_score > 70) | (opacity > 80) | (scaled > 80) | (font > 90)).alias("is_prominent"),
    )


def is_grid(display: Column) -> Column:
    return one_of(F.lower(F.trim(display)), ("grid", "inline-grid", "subgrid"))


def is_flex(display: Column) -> Column:
    return one_of(F.lower(F.trim(display)), ("flex", "inline-flex"))


def grid_description(s: Column) -> Column:
    """Tracks and gaps of a grid container, else null."""

    def tracks(name: str) -> Column:
        v = F.trim(F.coalesce(s[name], F.lit("")))
        return F.when(v.isin("", "none", "initial", "inherit", "revert"), F.array().cast("array<string>")).otherwise(F.split(v, r"\s+"))

    gap = lambda n: F.coalesce(s[n], F.lit("")).alias(n.replace("-", "_"))
    return F.when(is_grid(s["display"]), F.struct(tracks("grid-template-columns").alias("columns"), tracks("grid-template-rows").alias("rows"), gap("column-gap"), gap("row-gap")))


def flex_description(s: Column) -> Column:
    """Direction, axes, wrapping and gap of a flex container, else null."""
    d = F.lower(F.trim(F.coalesce(s["flex-direction"], F.lit("row"))))
    d = F.when(d.isin("row-reverse", "column", "column-reverse"), d).otherwise("row")
    upright = d.startswith("column")
    main, cross = F.when(upright, "vertical").otherwise("horizontal"), F.when(upright, "horizontal").otherwise("vertical")
    wraps = one_of(F.lower(F.trim(s["flex-wrap"])), ("wrap", "wrap-reverse"))
    return F.when(
        is_flex(s["display"]),
        F.struct(d.alias("direction"), wraps.alias("wrap"), F.coalesce(s["gap"], F.lit("")).alias("gap"), main.alias("main_axis"), cross.alias("cross_axis")),
    )


def responsive(s: Column) -> Column:
    """struct(strategy, signals) of a node whose styles tell how it adapts, else null."""
    def fluid(v: Column) -> Column:
        out = F.lit(False)
        for word in FLUID:
            out = out | includes(F.lower(v), word)
        return out

    width, least, most = s["width"], s["minWidth"], s["maxWidth"]
    fixed = F.coalesce(F.lower(F.trim(width)).rlike(r"^\d+(\.\d+)?(px|rem|em)$"), F.lit(False))
    wrap = F.lower(F.trim(F.coalesce(s["flex-wrap"], F.lit("nowrap"))))
    wraps = wrap.isin("wrap", "wrap-reverse")
    any_fluid = fluid(width) | fluid(least) | fluid(most)
    odd = ~any_fluid & ~wraps & truthy(width) & ~fixed
    tracks = is_grid(s["display"]) & (fluid(s["grid-template-columns"]) | fluid(s["grid-template-rows"]))
    clamps = includes(F.lower(s["fontSize"]), "clamp(")
    so_far = F.when(wraps, "flex-wrap").when(tracks, "grid-responsive").when(any_fluid | odd, "fluid-width").when(clamps, "clamp-font")
    rigid = so_far.isNull() & truthy(width) & ~fluid(least) & ~fluid(most)
    strategy = F.coalesce(so_far, F.when(rigid, F.lit("fixed-width")))

    def signal(on: Column, name: str, v: Column) -> Column:
        return F.when(on & truthy(v), F.concat(F.lit(f"{name}:"), v))

    signals = F.filter(
        F.array(
            F.when(wraps, F.concat(F.lit("flex-wrap:"), wrap)),
            F.when(wraps, F.concat(F.lit("flex-direction:"), F.lower(F.trim(F.coalesce(s["flex-direction"], F.lit("row")))))),
            signal(any_fluid | odd, "width", width),
            signal(any_fluid, "min-width", least),
            signal(any_fluid, "max-width", most),
            signal(tracks, "grid-template-columns", s["grid-template-columns"]),
            signal(tracks, "grid-template-rows", s["grid-template-rows"]),
            signal(clamps, "font-size", s["fontSize"]),
            signal(rigid, "width", width),
        ),
        lambda x: x.isNotNull(),
    )
    return F.when(F.size(signals) > 0, F.struct(F.coalesce(strategy, F.lit("none")).alias("strategy"), signals.alias("signals")))


def component_groups(nodes: DataFrame) -> DataFrame:
    """(page_id, group_id, kind, confidence, bounds, member_ids) of inferred components.

    ``nodes``: page_id, id, rect, style, children, seq. Flex and grid containers
    with two children or more are components; the nodes not yet in one are
    grouped where rectangles overlap by 24 pixels on both axes, in any number of
    steps. Groups are found by spreading the smallest ``seq`` along the links.
    """
    s, r = F.col("style"), F.col("rect")
    boxes = nodes.select("page_id", "id", "seq", "rect")
    holders = nodes.where((is_flex(s["display"]) | is_grid(s["display"])) & (F.size("children") >= 2))
    kids = holders.select("page_id", F.col("id").alias("holder"), F.col("seq").alias("holder_seq"), "style", F.size("children").alias("n_children"), F.posexplode("children").alias("pos", "child"))
    kids = kids.join(boxes.select("page_id", F.col("id").alias("child"), F.col("rect").alias("kid")), ["page_id", "child"], "left")
    k = F.col("kid")
    held = (
        kids.groupBy("page_id", "holder", "holder_seq", "n_children")
        .agg(
            F.count("kid").alias("found"),
            F.first(is_grid(s["display"])).alias("grid"),
            union_all(k["x"], k["y"], k["w"], k["h"]).alias("bounds"),
            F.transform(F.sort_array(F.collect_list(F.struct("pos", "child"))), lambda c: c["child"]).alias("member_ids"),
        )
        .where("found >= 2")
    )
    first = held.select(
        "page_id", F.col("holder").alias("group_id"), F.when(F.col("grid"), "grid-container").otherwise("flex-container").alias("kind"),
        F.least(F.lit(100), F.lit(60) + F.col("found") * 5).cast("int").alias("confidence"), "bounds", "member_ids",
    )
    taken = first.select("page_id", F.explode("member_ids").alias("id")).distinct()
    free = cut(nodes.select("page_id", "id", "seq", "rect", "style").join(taken, ["page_id", "id"], "left_anti"))
    labels = overlap_groups(free.select("page_id", "seq", "rect"))
    named = free.join(labels, ["page_id", "seq"])
    area = r["w"] * r["h"]
    groups = named.groupBy("page_id", "label").agg(
        F.count(F.lit(1)).alias("n"), union_all(r["x"], r["y"], r["w"], r["h"]).alias("bounds"),
        (F.max(r["y"]) - F.min(r["y"])).alias("y_range"), (F.max(r["h"]) - F.min(r["h"])).alias("h_range"), F.avg(area).alias("mean_area"),
        F.min_by("style", "seq").alias("style"), F.min_by("id", "seq").alias("first_id"),
        F.transform(F.sort_array(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"]).alias("member_ids"),
    ).where("n > 1")
    back, radius = F.coalesce(s["backgroundColor"], F.lit("")), F.coalesce(s["borderRadius"], F.lit(""))
    kind = (
        F.when((F.col("y_range") <= 8) & (F.col("h_range") <= 16) & (F.col("n") >= 3), "toolbar")
        .when((back != "") & (back != "rgba(0, 0, 0, 0)") & (radius != "0px"), "card")
        .otherwise("unknown")
    )
    second = groups.select(
        "page_id", F.col("first_id").alias("group_id"), kind.alias("kind"),
        F.least(F.lit(95), F.greatest(F.lit(40), F.lit(30) + F.col("n") * 8)).cast("int").alias("confidence"), "bounds", "member_ids",
    )
    return first.unionByName(second)


def overlap_groups(boxes: DataFrame, most: int = FOLD) -> DataFrame:
    """(page_id, seq, label): boxes of one label are linked by overlaps of ``PROXIMITY`` on both axes; a box linked to none has a label of its own.

    ``boxes``: page_id, seq (one a row of its page), rect. What a box within
    another overlaps, the other overlaps too, so only the outer one looks for
    more: the boxes of a crowded page are dealt to blocks, those within another
    of their block are held by it and leave, and what is left is dealt again
    until a page is one block, or blocks no longer halve. The rest meets in cells.
    """
    r = F.col("rect")
    # rectangles share PROXIMITY on an axis if they touch when made so much shorter; those that are shorter share it with none
    ends = {"x1": r["x"] + r["w"] - PROXIMITY, "y1": r["y"] + r["h"] - PROXIMITY}
    flat = boxes.select("page_id", "seq", r["x"].alias("x"), r["y"].alias("y"), *[v.alias(k) for k, v in ends.items()], "rect")
    left, held = cut(flat.where("x1 >= x and y1 >= y")), []
    sizes = cut(left.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")))
    while True:
        crowded = sizes.where(F.col("n") > most).select("page_id", F.ceil(F.col("n") / most).cast("int").alias("blocks"))
        if crowded.isEmpty():
            break
        dealt = left.join(crowded, "page_id").withColumn("block", F.pmod(F.xxhash64("seq", F.lit(len(held))), F.col("blocks")))
        found = cut(dealt.select("page_id", "block", "seq", "x", "y", "x1", "y1").groupBy("page_id", "block").applyInArrow(_within, "page_id string, seq long, holder long"))
        held.append(found)
        left = cut(left.join(found, ["page_id", "seq"], "left_anti"))
        now = cut(left.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")))
        # pages that do not halve any more are done
        sizes = cut(now.join(sizes.select("page_id", F.col("n").alias("before")), "page_id").where(F.col("n") * 2 <= F.col("before")).select("page_id", "n"))
    c = grouped(left.select("page_id", "seq", "rect"), r, "seq")
    cell = ["page_id", "q_level", "q_x", "q_y", "q_block"]
    shared = c.select(*cell, "seq", "rect.x", "rect.y", "rect.w", "rect.h")
    links = cut(shared.groupBy(*cell).applyInArrow(_cell_links, "page_id string, a long, b long").distinct())
    labels = left.select("page_id", "seq").join(spread_least(links), ["page_id", "seq"], "left").select("page_id", "seq", F.coalesce("label", "seq").alias("label"))
    for found in reversed(held):
        # a holder that was held itself has its label by now
        labels = cut(labels.unionByName(found.join(labels.withColumnRenamed("seq", "holder"), ["page_id", "holder"]).select("page_id", "seq", "label")))
    return labels


def _within(table: pa.Table) -> pa.Table:
    """(page_id, seq, holder): boxes within another of the block, each with a box that is within no other."""
    seq, x, y, x1, y1 = (table.column(c).to_numpy() for c in ("seq", "x", "y", "x1", "y1"))
    # whatever holds a box is no smaller; of equal ones the first holds the others
    order = np.lexsort((seq, y + 0.0, x + 0.0, -y1, -x1, -((x1 - x) + (y1 - y))))
    seq, x, y, x1, y1 = (v[order] for v in (seq, x, y, x1, y1))
    inner, outer = [], []
    while len(seq):
        inside = (x >= x[0]) & (y >= y[0]) & (x1 <= x1[0]) & (y1 <= y1[0])
        inside[0] = False
        inner.append(seq[inside])
        outer.append(np.full(len(inner[-1]), seq[0]))
        stay = ~inside
        stay[0] = False
        seq, x, y, x1, y1 = (v[stay] for v in (seq, x, y, x1, y1))
    inner, outer = np.concatenate(inner), np.concatenate(outer)
    page = table.column("page_id")[0].as_py()
    return pa.table({"page_id": pa.array([page] * len(inner), pa.string()), "seq": inner.astype(np.int64), "holder": outer.astype(np.int64)})


def _cell_links(table: pa.Table) -> pa.Table:
    """Links, both ways, that join what touches within one cell: a tree of each group, not all pairs."""
    seq, x, y, w, h = (table.column(c).to_numpy() for c in ("seq", "x", "y", "w", "h"))
    # rectangles share PROXIMITY on an axis if they touch when made so much shorter; those that are shorter share it with none
    x1, y1 = x + w - PROXIMITY, y + h - PROXIMITY
    left, a, b = (x1 >= x) & (y1 >= y), [], []
    for first in range(len(seq)):
        if not left[first]:
            continue
        left[first], todo = False, [first]
        while todo:
            i = todo.pop()
            near = np.flatnonzero(left & (x <= x1[i]) & (x1 >= x[i]) & (y <= y1[i]) & (y1 >= y[i]))
            left[near] = False
            a += [seq[i]] * len(near)
            b += seq[near].tolist()
            todo += near.tolist()
    page = table.column("page_id")[0].as_py()
    ends = np.array([*a, *b], np.int64), np.array([*b, *a], np.int64)
    return pa.table({"page_id": pa.array([page] * (2 * len(a)), pa.string()), "a": ends[0], "b": ends[1]})


def spread_least(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(page_id, seq, label): the smallest seq each node reaches along ``links(page_id, a, b)``, both ways.

    Each round takes the least label of the neighbours and then the label of
    that label, so chains shorten exponentially.
    """
    labels = cut(links.groupBy("page_id", F.col("a").alias("seq")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    for _ in range(max_rounds):
        near = links.join(labels.select("page_id", F.col("seq").alias("b"), "label"), ["page_id", "b"]).groupBy("page_id", F.col("a").alias("seq")).agg(F.min("label").alias("low"))
        step = labels.join(near, ["page_id", "seq"], "left").select("page_id", "seq", "label", F.least("label", F.coalesce("low", "label")).alias("new"))
        jump = labels.select("page_id", F.col("seq").alias("new"), F.col("label").alias("far"))
        nxt = cut(step.join(jump, ["page_id", "new"], "left").select("page_id", "seq", F.least("new", F.coalesce("far", "new")).alias("label"), (F.least("new", F.coalesce("far", "new")) < F.col("label")).alias("moved")))
        labels = nxt.select("page_id", "seq", "label")
        if nxt.where("moved").isEmpty():
            return labels
    raise RuntimeError("labels did not settle")


def visual_nodes(raw: DataFrame) -> DataFrame:
    """Visual nodes of captured elements: boxes, containers, stacking, scrolling and tethers in one row each.

    ``raw``: page_id, id, ax_id, parent_ax_id, tag, element_id, class_name,
    rect, style, child_count, scroll_w, scroll_h, client_w, client_h, seq.
    Tethers name visual nodes; an element without one keeps its own id there.
    """
    s, r = F.col("style"), F.col("rect")
    built = raw.select(
        "id", "ax_id", "page_id", "rect", "style", "seq", box_model(r, s).alias("box"), stacking_context(s).alias("stack"),
        scroll_context(s, "scroll_w", "scroll_h", "client_w", "client_h").alias("scroll"), render_bounds(r, r, s).alias("bounds"), "tag", "element_id", "class_name", "child_count",
    )
    kind = container_type(r, s, "tag", "element_id", "class_name", "child_count", F.col("scroll.is_scroll_container"))
    built = built.withColumn("container_type", kind)
    names = raw.select(F.col("ax_id").alias("ref"), F.col("id").alias("named"))
    t = tethers(raw)
    empty = F.array().cast("array<string>")

    def renamed(column: str) -> DataFrame:
        refs = t.select("ax_id", F.posexplode(column).alias("pos", "ref")).join(names, "ref", "left")
        listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("named", "ref").alias("name")))), lambda x: x["name"])
        return refs.groupBy("ax_id").agg(listed.alias(f"_{column}"))

    parts = ("children", "siblings_before", "siblings_after")
    up = t.select("ax_id", F.col("parent").alias("ref"), "anchors").join(names, "ref", "left").select("ax_id", F.coalesce("named", "ref").alias("_parent"), "anchors")
    out = built.join(up, "ax_id", "left")
    for p in parts:
        # layout siblings are ids already; children and siblings are element ids
        out = out.join(renamed(p), "ax_id", "left")
    whole = F.struct(F.col("_parent").alias("parent"), *[F.coalesce(f"_{p}", empty).alias(p) for p in parts], "anchors")
    return out.select(
        "id", "ax_id", "page_id", "rect", "style", whole.alias("tethers"), (F.col("container_type") != "none").alias("is_visual_container"), "container_type", F.col("box.box_sizing").alias("box_sizing"),
        F.col("box.padding_box").alias("padding_box"), F.col("scroll.is_scroll_container").alias("is_scroll_container"), F.col("stack.is_stacking_context").alias("is_stacking_context"), F.col("stack.z_index").alias("z_index"),
        F.col("bounds.has_transform").alias("has_transform"), F.lit("visual:walker").alias("provenance"), "seq",
    )


def interpret(nodes: DataFrame) -> DataFrame:
    """``nodes`` with grid, flex, prominence and responsive columns."""
    s = F.col("style")
    return nodes.withColumns({"grid": grid_description(s), "flex": flex_description(s), "prominence": prominence(s), "responsive": responsive(s)})
