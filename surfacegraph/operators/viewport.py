"""Nodes at several viewports: observations, fall-back look-ups, differences, layout mutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.js import is_, round_to, truthy, yes

#: The default viewports (name, width, height, device pixel ratio).
DEFAULTS = (("desktop", 1440, 900, 1.0), ("laptop", 1280, 800, 1.0), ("tablet", 768, 1024, 2.0), ("mobile", 390, 844, 3.0))


def observations_by_element(visual: DataFrame, observed: DataFrame) -> DataFrame:
    """Observations of each element at each viewport name, one each, widest first.

    ``visual``: ax_id, viewport struct(name, w), rect, style, visibility, seq.
    ``observed``: the same columns. What a visual node itself shows comes first.
    """
    cols = ["ax_id", "viewport", "rect", "style", "visibility", "seq"]
    both = visual.where("viewport is not null").select(*cols, F.lit(0).alias("side")).unionByName(observed.select(*cols, F.lit(1).alias("side")))
    w = Window.partitionBy("ax_id", F.lower("viewport.name")).orderBy("side", "seq")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "side").orderBy("ax_id", F.desc("viewport.w"), "seq")


def at_viewport(elements: DataFrame, observed: DataFrame, visual: DataFrame, name: str | None = None, width: float | None = None) -> DataFrame:
    """For each element its view at a viewport: an observation, else a visual node of that viewport, else the primary node's own by name or width.

    ``elements``: ax_id. ``observed``, ``visual``: ax_id, viewport, rect, style, visibility, seq.
    """

    def fits(v: Column) -> Column:
        by_name = F.lower(v["name"]) == (name or "").lower() if name else F.lit(False)
        by_width = v["w"] == width if width is not None else F.lit(False)
        return F.coalesce(by_name | by_width, F.lit(False))

    cols = ["ax_id", "viewport", "rect", "style", "visibility", "seq"]
    ranked = observed.where(fits(F.col("viewport"))).select(*cols, F.lit(0).alias("level")).unionByName(
        visual.where(fits(F.col("viewport"))).select(*cols, F.lit(1).alias("level"))
    )
    best = ranked.groupBy("ax_id").agg(F.min_by(F.struct(*cols[1:5]), F.struct("level", "seq")).alias("view"))
    return elements.join(best, "ax_id", "left").select("ax_id", "view.viewport", "view.rect", "view.style", "view.visibility")


#: Views of a side that one task pairs up.
MOST_VIEWS = 20_000


def pair_up(base: DataFrame, other: DataFrame, most: int = MOST_VIEWS) -> DataFrame:
    """(page_id, ax_id, a, b): the two views of each element. Both: page_id, ax_id, rect, style, visibility.

    Styles are wide, but alike, and shuffle as a hundredth of what they are: by
    shuffled bytes a few tasks would be given all of them. So tasks go by rows.
    """
    keys = ["page_id", "ax_id"]
    parts = -(-max(base.count(), other.count()) // most)

    def pack(df: DataFrame, name: str) -> DataFrame:
        packed = df.select(*keys, F.struct("rect", "style", "visibility").alias(name))
        return packed if parts <= 1 else packed.repartition(parts, *keys)

    return pack(base, "a").join(pack(other, "b"), keys)


def differences(pairs: DataFrame) -> DataFrame:
    """Position, size and style changes of paired views."""
    a, b = F.col("a.rect"), F.col("b.rect")

    def percent(k: str) -> Column:
        return F.when(a[k] > 0, (b[k] - a[k]) / a[k] * 100).otherwise(0.0)

    keys = F.array_sort(F.array_distinct(F.concat(F.map_keys("a.style"), F.map_keys("b.style"))))
    changed = F.filter(keys, lambda k: ~F.col("a.style")[k].eqNullSafe(F.col("b.style")[k]))
    deltas = F.transform(changed, lambda k: F.struct(k.alias("property"), F.col("a.style")[k].alias("from"), F.col("b.style")[k].alias("to")))
    return pairs.select(
        "page_id", "ax_id", (b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"), (b["w"] - a["w"]).alias("dw"), (b["h"] - a["h"]).alias("dh"),
        round_to(percent("w"), 2).alias("width_percent"), round_to(percent("h"), 2).alias("height_percent"),
        (F.col("a.visibility") != F.col("b.visibility")).alias("visibility_changed"), deltas.alias("style_changes"),
    )


def summary(changes: DataFrame) -> DataFrame:
    """``differences`` with a sentence for each element."""
    move = F.format_string("moved by (%s, %s)", F.col("dx").cast("long").cast("string"), F.col("dy").cast("long").cast("string"))
    size = F.format_string("resized by (%s, %s)", F.col("dw").cast("long").cast("string"), F.col("dh").cast("long").cast("string"))
    parts = F.array_compact(
        F.array(
            F.when((F.col("dx") != 0) | (F.col("dy") != 0), move),
            F.when((F.col("dw") != 0) | (F.col("dh") != 0), size),
            F.when(yes("visibility_changed"), F.lit("visibility changed")),
            F.when(F.size("style_changes") > 0, F.format_string("%d styles changed", F.size("style_changes"))),
        )
    )
    return changes.withColumn("summary", F.when(F.size(parts) > 0, F.concat_ws("; ", parts)).otherwise("no change"))


def mutations(pairs: DataFrame) -> DataFrame:
    """(page_id, ax_id, type, severity): hide, show, reorder, reflow, reposition or unchanged.

    ``pairs`` may have ``a_index`` and ``b_index``, places among siblings.
    """
    a, b, fs, ts = F.col("a.rect"), F.col("b.rect"), F.col("a.style"), F.col("b.style")
    was = is_("a.visibility", "visible") & (a["w"] > 0) & (a["h"] > 0)
    now = is_("b.visibility", "visible") & (b["w"] > 0) & (b["h"] > 0) & ~is_(ts["display"], "none") & ~is_(ts["visibility"], "hidden")
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]

    def percent(k: str) -> Column:
        return F.abs(F.when(a[k] > 0, (b[k] - a[k]) / a[k] * 100).otherwise(0.0))

    def shifted(k: str) -> Column:
        return truthy(fs[k]) & truthy(ts[k]) & (fs[k] != ts[k])

    structure = shifted("flex-direction") | shifted("grid-template-columns") | shifted("display")
    pw, ph = percent("w"), percent("h")
    if {"a_index", "b_index"} <= set(pairs.columns):
        moved = F.coalesce(F.col("a_index") != F.col("b_index"), F.lit(False))
    else:
        moved = F.lit(False)
    kind = (
        F.when(was & ~now, "hide").when(~was & now, "show").when(~was & ~now, "unchanged").when(moved, "reorder")
        .when(structure | (pw >= 15) | (ph >= 15), "reflow").when((F.abs(dx) >= 10) | (F.abs(dy) >= 10), "reposition").otherwise("unchanged")
    )
    severity = (
        F.when(kind.isin("hide", "show", "reorder"), "high")
        .when(kind == "reflow", F.when(structure | (pw > 50) | (ph > 50), "high").otherwise("medium"))
        .when(kind == "reposition", F.when((F.abs(dx) > 100) | (F.abs(dy) > 100), "medium").otherwise("low"))
        .otherwise("none")
    )
    return pairs.select("page_id", "ax_id", kind.alias("type"), severity.alias("severity"))


def page_mutations(changes: DataFrame) -> DataFrame:
    """Counts of mutation types by page."""
    kinds = ("reflow", "hide", "show", "reorder", "reposition", "unchanged")
    return changes.groupBy("page_id").agg(*[F.count_if(F.col("type") == k).alias(f"{k}_count") for k in kinds], F.count(F.lit(1)).alias("total_elements"))
