"""Visual patterns of nodes: floating buttons, backdrops, dialogs, headers, footers,
dismiss buttons, form groups and toasts.

Six patterns look at one node; two look at other nodes of the page, and those
meet through the cells of a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.css import styled, translucent
from ..functions.geometry import bottom, point, rect, right
from ..functions.js import includes, is_, number_or, one_of, yes
from ..plans.lineage import stored
from .quadtree import meet

# Fixed values of the rules.
INTERACTIVE = ("button", "link", "checkbox", "radio", "switch", "tab", "menuitem", "combobox", "textbox", "spinbutton")
CLOSE = r"(?i)^(close|dismiss|cancel|clear|times|exit|done|✕|✖|×|x)$"
CLOSE_DIALOG = r"(?i)close\s+dialog|dismiss\s+dialog|close\s+modal"


def interactive(s: Column, role: Column, focusable: Column) -> Column:
    """By role, focus or a pointer cursor."""
    return one_of(F.lower(role), INTERACTIVE) | yes(focusable) | is_(s["cursor"], "pointer")


def _found(on: Column, name: str, confidence) -> Column:
    c = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    return F.when(on, F.struct(F.lit(name).alias("pattern"), c.cast("double").alias("confidence")))


def own_patterns(r: Column, s: Column, role: Column, name: Column, focusable: Column, vw: float, vh: float) -> list[Column]:
    """Patterns that one node shows, in their order; two slots are left for the page."""
    position = F.coalesce(s["position"], F.lit("static"))
    floating, stuck = position.isin("fixed", "absolute"), position.isin("sticky", "fixed")
    z = number_or(s["zIndex"], 0)
    role, label = F.lower(F.coalesce(role, F.lit(""))), F.trim(F.lower(F.coalesce(name, F.lit(""))))
    acts = interactive(s, role, focusable)
    shadow = styled(s, "boxShadow")
    round_ = (number_or(s["borderRadius"], 0) >= 12) | includes(s["borderRadius"], "%")

    # as 1440 * 0.35 is a double just below 504, hundredths come last
    corner = (bottom(r) >= vh * 0.6) & ((right(r) >= vw * 0.6) | (r["x"] <= vw * 35 / 100))
    compact = r["w"].between(28, 140) & r["h"].between(28, 140)
    points = F.lit(60) + F.when(corner, 15).otherwise(0) + F.when(compact, 10).otherwise(0) + F.when(shadow | round_, 10).otherwise(0)
    # the sums are of doubles in the rules, and 0.6 + 0.15 is just what reaches 0.75
    fab = floating & acts & (corner | (compact & (shadow | round_))) & (points >= 75)

    full = (r["w"] >= vw * 0.75) & (r["h"] >= vh * 0.75) & (r["x"] <= 30) & (r["y"] <= 30)
    see_through = (number_or(s["opacity"], 0) < 0.98) | translucent(s["backgroundColor"]) | styled(s, "backdropFilter")
    backdrop = floating & full & (see_through | (z >= 5))

    says_dialog = role.isin("dialog", "alertdialog")
    centred = (F.abs(r["x"] + r["w"] / 2 - vw / 2) <= vw * 0.25) & (F.abs(r["y"] + r["h"] / 2 - vh / 2) <= vh * 0.25)
    sized = (r["w"] >= 180) & (r["h"] >= 80) & ((r["w"] < vw * 0.95) | (r["h"] < vh * 0.95))
    dialog = says_dialog | (floating & centred & sized & ((z >= 10) | shadow))

    wide, low = r["w"] >= vw * 0.65, r["h"].between(24, 260)
    sticky = F.when(position == "sticky", 0.95).otherwise(0.9)
    closes = acts & (label.rlike(CLOSE) | label.rlike(CLOSE_DIALOG))

    alert = role.isin("alert", "status")
    toast = floating & (alert | (z >= 100)) & ((r["y"] <= 120) | (bottom(r) >= vh - 120)) & r["w"].between(160, 480) & r["h"].between(32, 180)
    return [
        _found(fab, "fab", points / 100),
        _found(backdrop, "modal-backdrop", F.when(see_through, 0.95).otherwise(0.85)),
        _found(dialog, "dialog-overlay", F.when(says_dialog, 0.98).otherwise(0.85)),
        _found(stuck & (r["y"] <= 20) & wide & low, "sticky-header", sticky),
        _found(stuck & (bottom(r) >= vh - 40) & wide & low, "sticky-footer", sticky),
        _found(closes, "dismiss-button", 0.95),
        _found(toast, "toast-notification", F.when(alert, 0.95).otherwise(0.85)),
    ]


def _beside(nodes: DataFrame, few: DataFrame) -> DataFrame:
    """The nodes of pages that have any of ``few``: on others there is none to meet."""
    return nodes.join(few.select("page_id").distinct(), "page_id", "left_semi")


def _corner_buttons(nodes: DataFrame) -> DataFrame:
    """(id): small buttons in the upper right corner of some other node."""
    s, r = F.col("style"), F.col("rect")
    small = nodes.where(is_(F.lower("role"), "button") & (r["w"] <= 50) & (r["h"] <= 50))
    # the corner that a holder offers is a box of 60 by 60; a button is in it by its own corner
    x1 = right(r)
    at = small.select("page_id", "id", r.alias("rect"), point(r).alias("corner"))
    holders = _beside(nodes, at).select("page_id", F.col("id").alias("holder"), r.alias("o"))
    o = F.col("o")
    holders = holders.withColumn("offered", rect(right(o) - 61, o["y"] - 1, F.lit(72), F.lit(62)))
    inside = (
        (r["x"] >= o["x"]) & (r["y"] >= o["y"]) & (x1 <= right(o) + 10) & (bottom(r) <= bottom(o)) & (r["x"] >= right(o) - 60) & (r["y"] <= o["y"] + 60)
    )
    return meet(at, holders, "corner", "offered", high_key="holder").where((F.col("id") != F.col("holder")) & inside).select("id").distinct()


def _form_groups(nodes: DataFrame) -> DataFrame:
    """(id, held, has_input): nodes that may group, and what lies in them."""
    role = F.lower(F.coalesce("role", F.lit("")))
    groups = nodes.where(role.isin("group", "form") | one_of("container_type", ("container", "wrapper")))
    r = F.col("rect")
    # what counts as inside may begin, and end, at the edge
    around = rect(r["x"] - 5, r["y"] - 5, r["w"] + 10, r["h"] + 10)
    holders = groups.where((r["w"] > -10) & (r["h"] > -10)).select("page_id", "id", around.alias("g"))
    s = F.col("style")
    like_input = is_(s["cursor"], "text") | is_(s["cursor"], "pointer")
    others = _beside(nodes, holders).select("page_id", F.col("id").alias("other"), r.alias("o"), point(r).alias("corner"), like_input.alias("input"))
    g, o = F.col("g"), F.col("o")
    inside = (o["x"] >= g["x"]) & (o["y"] >= g["y"]) & (right(o) <= right(g)) & (bottom(o) <= bottom(g))
    met = meet(holders, others, "g", "corner").where((F.col("id") != F.col("other")) & inside)
    return met.groupBy("id").agg(F.count(F.lit(1)).alias("held"), F.max("input").alias("has_input"))


def patterns(nodes: DataFrame, viewport_w: float = 1440, viewport_h: float = 900) -> DataFrame:
    """(page_id, id, patterns array<struct<pattern, confidence>>, primary_pattern) of nodes with any.

    ``nodes``: page_id, id, rect, style, role, name, focusable, container_type.
    """
    s, r = F.col("style"), F.col("rect")
    # read once for the node's own patterns, and twice for each pattern of the page: what nodes are made of is not done anew
    nodes = stored(nodes.select("page_id", "id", "rect", "style", "role", "name", "focusable", "container_type"))
    corner = _corner_buttons(nodes).withColumn("in_corner", F.lit(True))
    forms = _form_groups(nodes)
    df = nodes.join(corner, "id", "left").join(forms, "id", "left")
    own = own_patterns(r, s, F.col("role"), F.col("name"), F.col("focusable"), viewport_w, viewport_h)
    role = F.lower(F.coalesce("role", F.lit("")))
    acts = interactive(s, role, F.col("focusable"))
    by_role = role.isin("group", "form")
    in_corner = own[5].isNull() & acts & (role == "button") & (r["w"] <= 50) & (r["h"] <= 50) & yes("in_corner")
    grouped = (by_role | one_of("container_type", ("container", "wrapper"))) & F.coalesce(F.col("held").between(1, 10), F.lit(False)) & (yes("has_input") | by_role)
    slots = [*own[:5], F.coalesce(own[5], _found(in_corner, "dismiss-button", 0.85)), _found(grouped, "form-group", F.when(by_role, 0.95).otherwise(0.85)), own[6]]
    found = F.filter(F.array(*slots), lambda p: p.isNotNull())
    out = df.select("page_id", "id", found.alias("patterns")).where(F.size("patterns") > 0)
    return out.withColumn("primary_pattern", F.col("patterns")[0]["pattern"])


def nodes_with_pattern(visual: DataFrame, page_id: str | None = None, pattern: str | None = None, min_confidence: float = 0.5) -> DataFrame:
    """Visual nodes that have a pattern (a given one) of at least ``min_confidence``."""
    df = visual if page_id is None else visual.where(F.col("page_id") == page_id)
    return df.where(
        F.exists("patterns", lambda p: (p["confidence"] >= min_confidence) & ((p["pattern"] == pattern) if pattern else F.lit(True)))
    )
