"""More queries: conditions of requests, look-ups, upserts, relations and tools.

Elements, visual nodes, observations, navigation structures, transitions and
states are projected from whole tables; each expression is text that Spark SQL
and ANSI engines both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import query
from .operators import govern, occlusion, patterns, report, select, state, traverse, viewport
from .plans import derive
from .plans.catalog import Catalog, last_wins, merge_visual
from .plans.derive import K, cases

C, N, E = "c_custkey", "n_nationkey", "event_id"
AX = derive.AX | {
    "expanded": f"CASE {C} % 4 WHEN 0 THEN true WHEN 1 THEN false END",
    "disabled": f"{C} % 3 = 0",
    "here": f"CASE {C} % 5 WHEN 0 THEN 'page' WHEN 1 THEN 'true' END",
}
VISUAL = {
    "id": f"concat('v', {K})", "ax_id": f"concat('ax', {K})", "page_id": f"concat('page', {K} % 60)", "seq": K,
    "x": derive.COLUMNS["x"], "y": derive.COLUMNS["y"], "w": derive.COLUMNS["w"], "h": derive.COLUMNS["h"],
    "vp_name": f"CASE {K} % 4 WHEN 0 THEN 'Mobile' WHEN 1 THEN 'desktop' END",
    "vp_w": f"CASE {K} % 4 WHEN 0 THEN cast(390 AS double) WHEN 1 THEN cast(1440 AS double) END",
    "holds": f"CASE WHEN {K} % 7 <> 0 THEN {K} % 3 = 0 END",
    "container_type": derive.COLUMNS["container_type"],
    "scrolls": f"{K} % 5 = 0", "stacks": f"CASE WHEN {K} % 2 = 0 THEN {K} % 4 = 0 END", "transformed": f"{K} % 8 = 2",
    "box_sizing": f"CASE WHEN {K} % 2 = 0 THEN 'border-box' ELSE 'content-box' END",
    "ratio": f"CASE WHEN {K} % 9 <> 0 THEN cast({K} % 11 AS double) / 10 END", "covered": f"{K} % 11 < 5", "away": f"{K} % 13 = 0",
    "pattern_a": f"CASE WHEN {K} % 5 = 0 THEN 'fab' END",
    "pattern_b": f"CASE {K} % 7 WHEN 0 THEN 'sticky-header' WHEN 1 THEN 'sticky-footer' END",
    "pattern_c": f"CASE {K} % 6 WHEN 0 THEN 'modal-backdrop' WHEN 1 THEN 'dismiss-button' WHEN 2 THEN 'form-group' END",
    "ref": f"CASE WHEN {K} % 6 = 0 THEN 'color.accent' END", "bound": f"CASE WHEN {K} % 10 = 0 THEN 'color.b' END",
    "drift": f"CASE {K} % 8 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END",
    "anchor": f"CASE WHEN {K} % 3 = 0 THEN concat('ax', {K} % 50) END",
}
SEEN = {
    "ax_id": f"concat('ax', {K})", "name": f"CASE {K} % 5 WHEN 0 THEN 'mobile' WHEN 1 THEN 'tablet' ELSE 'desktop' END",
    "w": f"CASE {K} % 5 WHEN 0 THEN cast(390 AS double) WHEN 1 THEN cast(768 AS double) ELSE cast(1440 AS double) END",
    "visibility": f"CASE {K} % 3 WHEN 0 THEN 'hidden' WHEN 1 THEN 'visible' ELSE 'display-none' END",
    "display": f"CASE WHEN {K} % 4 = 0 THEN 'none' ELSE 'block' END", "seq": K,
}
NAV = {
    "id": f"concat('nav', {N})", "page_id": f"concat('page', {N} % 10)", "kind": f"CASE {N} % 5 WHEN 0 THEN 'breadcrumb' WHEN 1 THEN 'menu' WHEN 2 THEN 'tablist' WHEN 3 THEN 'menubar' ELSE 'nav' END",
    "container_ax_id": "concat('ax', n_regionkey)", "name": "n_name", "first_member": f"concat('ax', {N} * 3 + 2)", "second_member": f"concat('ax', {N} * 3 + 1)", "seq": N,
}
TRANSITIONS = {"id": f"concat('trans', {E})", "from_ax_id": f"concat('ax', {E} % 50)", "trigger": "event_type", "seq": E}
STATES = {
    "id": f"concat('state:', {E})", "page_id": "concat('page', user_id % 20)", "route": "event_type", "auth_kind": "CASE WHEN user_id % 3 = 0 THEN 'anonymous' ELSE 'authenticated' END",
    "network_evidence": "CASE WHEN user_id % 2 = 0 THEN 'observed' ELSE 'assumed' END", "dialog": f"CASE WHEN {E} % 4 = 0 THEN 'd1' END", "popover": f"CASE WHEN {E} % 5 = 0 THEN 'p1' END", "seq": E,
}
PAGE_TREE = "SELECT concat('page', cast(floor(page_id / 3) AS bigint)) AS src, concat('page', page_id) AS dst, page_id AS seq FROM pages WHERE page_id > 0"


def listed(*columns: str):
    """An array of the columns that are not null."""
    return F.array_compact(F.array(*[F.col(c) for c in columns]))


def rich(spark, sf) -> Catalog:
    """A catalog with every column that a request can ask for."""
    p = lambda table, columns: derive.projected(spark, sf, table, columns)
    null = F.lit(None).cast("string")
    ax = p("customer", AX).select("id", "page_id", "role", "name", F.struct("expanded", "disabled", F.col("here").alias("current")).alias("states"), "seq")
    v = p("part", VISUAL)
    visual = v.select(
        "id", "ax_id", "page_id", F.struct("x", "y", "w", "h").alias("rect"), F.create_map(F.lit("display"), F.lit("block")).alias("style"), "seq",
        F.when(F.col("vp_name").isNotNull(), F.struct(F.col("vp_name").alias("name"), F.col("vp_w").alias("w"))).alias("viewport"),
        F.col("holds").alias("is_visual_container"), "container_type", F.col("scrolls").alias("is_scroll_container"), F.col("stacks").alias("is_stacking_context"), F.col("transformed").alias("has_transform"), "box_sizing",
        F.struct(F.col("ratio").alias("visible_ratio"), F.col("covered").alias("is_occluded"), F.col("away").alias("is_offscreen")).alias("occlusion"),
        F.transform(listed("pattern_a", "pattern_b", "pattern_c"), lambda n: F.struct(n.alias("pattern"), F.lit(0.8).alias("confidence"))).alias("patterns"),
        listed("ref").alias("refs"), listed("bound").alias("bindings"), listed("drift").alias("drift_severities"),
        F.struct(null.alias("parent"), F.when(F.col("anchor").isNotNull(), F.array(F.struct(F.lit("a").alias("name"), F.col("anchor").alias("target")))).alias("anchors")).alias("tethers"),
    )
    seen = p("part", SEEN).select("ax_id", F.col("name").alias("vp_key"), F.struct("name", "w").alias("viewport"), "visibility", F.create_map(F.lit("display"), F.col("display")).alias("style"), "seq")
    nav = p("nation", NAV).select("id", "page_id", "kind", "container_ax_id", listed("first_member", "second_member").alias("member_ax_ids"), "name", "seq")
    states = p("events", STATES).select("id", "page_id", "route", "auth_kind", "network_evidence", listed("dialog").alias("open_dialog_ids"), listed("popover").alias("open_popover_ids"), "seq")
    caps = p("part", derive.CAPS).withColumns({"binding": F.struct(F.lit("ax-node").alias("kind"), "ax_id"), "security": govern.tier(F.lit("button"), F.col("name"), F.lit(0))})
    tables = {"pages": p("pages", derive.PAGES), "ax": ax, "visual": visual, "observations": seen, "nav": nav, "states": states, "capabilities": caps, "transitions": p("events", TRANSITIONS)}
    return Catalog(spark, tables | {"edges": relation_edges(spark, sf)})


def _edges(df: DataFrame, src: str, dst: str, kind: str, seq: str) -> DataFrame:
    e = df.select(F.expr(src).alias("src"), F.expr(dst).alias("dst"), F.lit(kind).alias("kind"), F.lit("derived").alias("provenance"), F.expr(f"cast({seq} AS bigint)").alias("seq"))
    return e.withColumn("id", F.concat(F.lit("edge:"), "src", F.lit("->"), "dst", F.lit(":"), "kind"))


def relation_edges(spark, sf) -> DataFrame:
    """Page tree, navigation links, tab membership and successors of states."""
    t = lambda name: derive.table(spark, sf, name)
    parts = [
        _edges(t("pages").where("page_id > 0"), "concat('page', cast(floor(page_id / 3) AS bigint))", "concat('page', page_id)", "nav:child-of", "page_id"),
        _edges(t("pages"), "concat('page', page_id % 10)", "concat('page', page_id)", "nav-link", "page_id"),
        _edges(t("customer"), f"concat('ax', {C})", f"concat('nav', {C} % 25)", "tab-of", C),
        _edges(t("events"), f"concat('state:', cast(floor({E} / 2) AS bigint))", f"concat('state:', {E})", "state:successor", E),
    ]
    out = parts[0]
    for e in parts[1:]:
        out = out.unionByName(e)
    return out


ROWS = (
    f"WITH p AS ({derive.sql('pages', derive.PAGES)}), ax AS ({derive.sql('customer', AX)}), v AS ({derive.sql('part', VISUAL)}), ob AS ({derive.sql('part', SEEN)}), "
    f"nav AS ({derive.sql('nation', NAV)}), st AS ({derive.sql('events', STATES)}), tr AS ({derive.sql('events', TRANSITIONS)}), cap AS ({derive.sql('part', derive.CAPS)})"
)
OF = {"ax-node": "ax", "visual-node": "v", "nav-element": "nav", "state": "st", "page": "p", "capability": "cap"}
ON_PAGE = "page_id IN (SELECT id FROM p)"


def conditions(name: str, cases_: list[tuple[str, str, dict, str]]) -> None:
    """Registers (condition, id) of the hits of several requests: (condition, kind, where, the same in SQL)."""

    def run(spark, sf):
        c, out = rich(spark, sf), None
        for label, kind, where, _ in cases_:
            one = select.select(c, kind, where).select(F.lit(label).alias("condition"), "id")
            out = one if out is None else out.unionByName(one)
        return out

    parts = []
    for label, kind, _, sql in cases_:
        known = f" AND {ON_PAGE}" if kind in ("visual-node", "nav-element") else ""
        parts.append(f"SELECT '{label}' AS condition, id FROM {OF[kind]} WHERE ({sql}){known}")
    query(name, f"{ROWS} {' UNION ALL '.join(parts)}")(run)


def by_look(sql: str) -> str:
    """Elements whose visual node fits."""
    return f"id IN (SELECT ax_id FROM v WHERE {sql})"


def on_both(cases_: list[tuple[str, dict, str]]) -> list[tuple[str, str, dict, str]]:
    """The conditions for visual nodes, and for elements by their visual node."""
    return [(label, "visual-node", w, s) for label, w, s in cases_] + [(f"{label} of element", "ax-node", w, by_look(s)) for label, w, s in cases_]


def has(pattern: str) -> str:
    return f"(coalesce(pattern_a, '') = '{pattern}' OR coalesce(pattern_b, '') = '{pattern}' OR coalesce(pattern_c, '') = '{pattern}')"


conditions("p_state", [
    ("expanded", "ax-node", {"state": {"expanded": True}}, "expanded"),
    ("collapsed", "ax-node", {"state": {"expanded": False, "disabled": True}}, "NOT expanded AND disabled"),
    ("no expansion", "ax-node", {"state": {"expanded": None}}, "expanded IS NULL"),
    ("current page", "ax-node", {"state": {"current": "page"}}, "here = 'page'"),
    ("current", "ax-node", {"state": {"current": True}}, "here = 'true'"),
])
conditions("p_has_capability", [
    ("end", "ax-node", {"hasCapability": "*ring"}, "page_id IN (SELECT page_id FROM cap WHERE ends_with(lower(name), 'ring'))"),
    ("start", "ax-node", {"hasCapability": "small r*"}, "page_id IN (SELECT page_id FROM cap WHERE starts_with(lower(name), 'small r'))"),
    ("part", "ax-node", {"hasCapability": "*ED W*"}, "page_id IN (SELECT page_id FROM cap WHERE contains(lower(name), 'ed w'))"),
    ("of capability", "capability", {"hasCapability": "red", "name": "widget"}, "contains(name, 'red') AND contains(name, 'widget')"),
])
conditions("p_design_token", on_both([("refers", {"designToken": "color.accent"}, "ref = 'color.accent'")]))
AT_MOBILE, AT_WIDE = "ax_id IN (SELECT ax_id FROM ob WHERE lower(name) = 'mobile')", "ax_id IN (SELECT ax_id FROM ob WHERE w = 1440)"
conditions("p_viewport", [
    ("name", "visual-node", {"viewport": "MOBILE"}, f"lower(vp_name) = 'mobile' OR {AT_MOBILE}"),
    ("width", "visual-node", {"viewport": {"w": 1440, "h": 1}}, f"vp_w = 1440 OR {AT_WIDE}"),
    ("name of element", "ax-node", {"viewport": "mobile"}, by_look(f"lower(vp_name) = 'mobile' OR {AT_MOBILE}")),
])
conditions("p_hidden_at_viewport", on_both([("hidden", {"visualHiddenAtViewport": "Mobile"}, "ax_id IN (SELECT ax_id FROM ob WHERE name = 'mobile' AND (visibility <> 'visible' OR display = 'none'))")]))
conditions("p_containers", on_both([
    ("container", {"isVisualContainer": True}, "coalesce(holds, FALSE)"),
    ("no container", {"isVisualContainer": False}, "NOT coalesce(holds, FALSE)"),
    ("type", {"containerType": ["container", "wrapper"]}, "container_type IN ('container', 'wrapper')"),
    ("scrolls", {"isScrollContainer": True}, "scrolls"),
    ("no stack", {"isStackingContext": False}, "NOT coalesce(stacks, FALSE)"),
    ("transformed", {"hasTransform": True, "boxSizing": "border-box"}, "transformed AND box_sizing = 'border-box'"),
]))
conditions("p_occlusion", on_both([
    ("covered", {"isOccluded": True}, "covered"),
    ("least", {"minVisibleRatio": 0.75}, "coalesce(ratio, 1) >= 0.75"),
    ("most", {"maxVisibleRatio": 0.25, "isOccluded": True}, "coalesce(ratio, 1) <= 0.25 AND covered"),
    ("away", {"isOffscreen": True}, "away"),
]))
conditions("p_patterns", on_both([
    ("one of", {"visualPattern": ["fab", "sticky-header"]}, f"{has('fab')} OR {has('sticky-header')}"),
    ("none", {"hasPattern": False}, "pattern_a IS NULL AND pattern_b IS NULL AND pattern_c IS NULL"),
    ("fab", {"isFab": True}, has("fab")),
    ("backdrop", {"isModalBackdrop": True}, has("modal-backdrop")),
    ("header", {"isStickyHeader": True}, has("sticky-header")),
    ("no footer", {"isStickyFooter": False, "isFab": True}, f"NOT {has('sticky-footer')} AND {has('fab')}"),
    ("dismiss", {"isDismissButton": True}, has("dismiss-button")),
    ("group", {"isFormGroup": True}, has("form-group")),
]))
conditions("p_token_state", [
    ("bound", "visual-node", {"hasTokenBinding": True}, "bound IS NOT NULL OR ref IS NOT NULL"),
    ("free", "visual-node", {"hasTokenBinding": False}, "bound IS NULL AND ref IS NULL"),
    ("path", "visual-node", {"tokenPath": "color.b"}, "bound = 'color.b'"),
    ("drifts", "visual-node", {"hasTokenDrift": True}, "drift IS NOT NULL"),
    ("severity", "visual-node", {"driftSeverity": "high"}, "drift = 'high'"),
])
conditions("p_nav", [
    ("kind", "nav-element", {"navKind": ["menu", "tablist"]}, "kind IN ('menu', 'tablist')"),
    ("page", "nav-element", {"navInPage": "page3"}, "page_id = 'page3'"),
    ("name", "nav-element", {"navKind": "breadcrumb", "name": "A"}, "kind = 'breadcrumb' AND contains(name, 'A')"),
])
conditions("p_states", [
    ("page", "state", {"stateOnPage": "page4"}, "page_id = 'page4'"),
    ("auth", "state", {"stateAuthKind": "anonymous", "stateNetworkEvidence": "observed"}, "auth_kind = 'anonymous' AND network_evidence = 'observed'"),
    ("dialog", "state", {"stateHasOpenDialog": "d1"}, "dialog = 'd1'"),
    ("popover", "state", {"stateHasOpenPopover": "p1", "stateRoute": "click"}, "popover = 'p1' AND contains(route, 'click')"),
])
conditions("p_anchors", [("anchor", "visual-node", {"inTether": {"axId": "ax12", "relation": "anchors"}}, "anchor = 'ax12'")])


# look-ups


def _union(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for label, df in parts.items():
        one = df.select(F.lit(label).alias("lookup"), "id")
        out = one if out is None else out.unionByName(one)
    return out


def _lookups(name: str, sql: dict[str, str], run) -> None:
    query(name, f"{ROWS}, e AS ({PAGE_TREE}) " + " UNION ALL ".join(f"SELECT '{k}' AS lookup, id FROM ({v})" for k, v in sql.items()))(lambda spark, sf: _union(run(rich(spark, sf))))


_lookups(
    "i_get",
    {n: f"SELECT id FROM {t} WHERE id = '{i}'" for n, t, i in (("page", "p", "page7"), ("element", "ax", "ax7"), ("visual", "v", "v7"), ("nav", "nav", "nav7"), ("capability", "cap", "cap7"), ("transition", "tr", "trans7"), ("state", "st", "state:7"))}
    | {"edge": "SELECT concat('edge:', src, '->', dst, ':nav:child-of') AS id FROM e WHERE src = 'page2' AND dst = 'page7'"},
    lambda c: {n: c.get(t, i) for n, t, i in (("page", "pages", "page7"), ("element", "ax", "ax7"), ("visual", "visual", "v7"), ("nav", "nav", "nav7"), ("capability", "capabilities", "cap7"), ("transition", "transitions", "trans7"), ("state", "states", "state:7"), ("edge", "edges", "edge:page2->page7:nav:child-of"))},
)
_lookups(
    "i_by_column",
    {
        "elements of page": "SELECT id FROM ax WHERE page_id = 'page3'", "role": "SELECT id FROM ax WHERE role = 'tab'", "visual of page": "SELECT id FROM v WHERE page_id = 'page3'",
        "containers": "SELECT id FROM v WHERE holds AND page_id = 'page4'", "visual of element": "SELECT id FROM v WHERE ax_id = 'ax9'", "nav of page": "SELECT id FROM nav WHERE page_id = 'page5'",
        "capabilities": "SELECT id FROM cap WHERE page_id = 'page5'", "transitions": "SELECT id FROM tr WHERE from_ax_id = 'ax11'",
        "states": "SELECT id FROM st WHERE page_id = 'page4' AND route = 'click' AND auth_kind = 'authenticated'",
        "out": "SELECT concat('edge:', src, '->', dst, ':nav:child-of') AS id FROM e WHERE src = 'page2'", "in": "SELECT concat('edge:', src, '->', dst, ':nav:child-of') AS id FROM e WHERE dst = 'page8'",
    },
    lambda c: {
        "elements of page": c.by_page("ax", "page3"), "role": c.ax_by_role("tab"), "visual of page": c.by_page("visual", "page3"), "containers": c.visual_containers("page4"), "visual of element": c.visual_by_ax("ax9"),
        "nav of page": c.by_page("nav", "page5"), "capabilities": c.by_page("capabilities", "page5"), "transitions": c.transitions_from("ax11"), "states": c.states_where("page4", "click", "authenticated"),
        "out": c.edges_from("page2", "nav:child-of"), "in": c.edges_to("page8", "nav:child-of"),
    },
)


@query("i_page_by_url", "SELECT concat('page', min(page_id)) AS id FROM pages WHERE page_id % 7 = 3")
def _(spark, sf):
    """The first of the pages that share a canonical URL."""
    c = rich(spark, sf)
    return c.with_tables(pages=c.pages.withColumn("canonical_url", F.concat(F.lit("u"), (F.col("seq") % 7).cast("string")))).page_by_url("u3").select("id")


@query("i_patterns", f"{ROWS} SELECT id FROM v WHERE page_id = 'page6' AND {has('fab')} OR page_id = 'page6' AND pattern_c IS NOT NULL")
def _(spark, sf):
    """Visual nodes of a page with a pattern of at least 0.5; the third pattern has 0.9, the others 0.4, a floating one 0.6."""
    v = rich(spark, sf).visual
    sure = F.transform("patterns", lambda p: F.struct(p["pattern"].alias("pattern"), F.when(p["pattern"] == "fab", 0.6).when(p["pattern"].isin("modal-backdrop", "dismiss-button", "form-group"), 0.9).otherwise(0.4).alias("confidence")))
    return patterns.nodes_with_pattern(v.withColumn("patterns", sure), page_id="page6").select("id")


@query("i_observations_by_element", f"{ROWS}, bo AS (SELECT ax_id, lower(vp_name) AS name, vp_w AS w, 0 AS side, seq FROM v WHERE vp_name IS NOT NULL UNION ALL SELECT ax_id, name, w, 1, seq FROM ob), k AS (SELECT *, row_number() OVER (PARTITION BY ax_id, name ORDER BY side) AS n FROM bo) SELECT ax_id, string_agg(name, '|' ORDER BY w DESC, name) AS names FROM k WHERE n = 1 GROUP BY ax_id")
def _(spark, sf):
    """Viewports at which elements were seen, the widest first: the visual node's own one and those observed."""
    c = rich(spark, sf)
    own, seen = c.visual.withColumn("visibility", F.lit("visible")), c.observations.withColumn("rect", F.lit(None).cast("struct<x:double,y:double,w:double,h:double>"))
    return viewport.observations_by_element(own, seen).withColumn("vp_key", F.lower("viewport.name")).groupBy("ax_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("viewport.w")).alias("w"), F.col("vp_key").alias("name")))), lambda o: o["name"]), "|").alias("names"))


# upserts


@query("m_visual", f"{ROWS}, m AS (SELECT 'v' || (seq % 40) AS id, max(seq) AS last, min(seq) AS first FROM v GROUP BY 1), o AS (SELECT 'a' || (seq % 40) AS ax_id, lower(vp_name) AS key, max(seq) AS last, min(seq) AS first FROM v WHERE vp_name IS NOT NULL GROUP BY 1, 2) SELECT 'node' AS kind, id, CAST(NULL AS VARCHAR) AS vp_key, CAST(last AS DOUBLE) AS last, first AS seq FROM m UNION ALL SELECT 'observation', ax_id, key, CAST(last AS DOUBLE), first FROM o")
def _(spark, sf):
    """Visual nodes and their observations after many upserts of the same ids."""
    v = rich(spark, sf).visual
    rows = v.select(F.concat(F.lit("v"), (F.col("seq") % 40).cast("string")).alias("id"), F.concat(F.lit("a"), (F.col("seq") % 40).cast("string")).alias("ax_id"), F.struct(F.col("seq").cast("double").alias("x")).alias("rect"), "style", "viewport", "seq")
    nodes, seen = merge_visual(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"))
    a = nodes.select(F.lit("node").alias("kind"), "id", F.lit(None).cast("string").alias("vp_key"), F.col("rect.x").alias("last"), "seq")
    return a.unionByName(seen.select(F.lit("observation").alias("kind"), F.col("ax_id").alias("id"), "vp_key", F.col("rect.x").alias("last"), "seq"))


@query("m_remove_edges", f"SELECT src, dst FROM ({PAGE_TREE}) WHERE seq % 3 > 0")
def _(spark, sf):
    c = rich(spark, sf)
    e = c.edges.where("kind = 'nav:child-of'")
    return c.with_tables(edges=e).remove_edges(e.where("seq % 3 = 0").select("id")).edges.select("src", "dst")


@query("m_diagnostics", f"SELECT CASE event_type WHEN 'error' THEN 'pageErrors' WHEN 'view' THEN 'extractionWarnings' ELSE 'extractorFailures' END AS kind, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1")
def _(spark, sf):
    """Diagnostics recorded in two runs and restored together."""
    e = derive.table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "error", "pageErrors").when(F.col("event_type") == "view", "extractionWarnings").otherwise("extractorFailures")
    rows = e.select(kind.alias("kind"), F.concat(F.lit("page"), "user_id").alias("page_id"), F.col("event_type").alias("message"), F.col("event_id").alias("seq"))
    c = Catalog(spark, {"diagnostics": rows.where("seq % 2 = 0")})
    c = c.with_tables(diagnostics=c.diagnostics.unionByName(rows.where("seq % 2 = 1")))
    return c.diagnostics.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))


# relations


def _members(name: str, start: str, relation: str, kinds: str) -> None:
    sql = f"{ROWS}, m AS (SELECT id AS nav_id, first_member AS id, 0 AS pos FROM nav WHERE container_ax_id = '{start}' AND kind IN ({kinds}) UNION ALL SELECT id, second_member, 1 FROM nav WHERE container_ax_id = '{start}' AND kind IN ({kinds})) SELECT nav_id, pos, id, name FROM m JOIN ax USING (id)"
    query(name, sql)(lambda spark, sf: traverse.relate(rich(spark, sf), start, relation).select("nav_id", "pos", "id", "name"))


_members("t_breadcrumbs", "ax0", "breadcrumbs", "'breadcrumb'")
_members("t_menu", "ax3", "menu", "'menu', 'menubar', 'tablist'")


@query("t_tab_of", f"{ROWS} SELECT id, name FROM nav WHERE kind = 'tablist' AND id = 'nav' || 32 % 25")
def _(spark, sf):
    return traverse.relate(rich(spark, sf), "ax32", "tab-of").select("id", "name")


@query("t_nav_links", f"{ROWS} SELECT id, seq FROM p WHERE seq % 10 = 3")
def _(spark, sf):
    return traverse.relate(rich(spark, sf), "page3", "nav-links").select("id", "seq")


PAGE_REACH = "WITH RECURSIVE e AS ({e}), d(id, hops) AS (SELECT 'page2', 0 UNION ALL SELECT e.dst, hops + 1 FROM d JOIN e ON e.src = d.id WHERE hops < 3), a(id, hops) AS (SELECT 'page49', 0 UNION ALL SELECT e.src, hops + 1 FROM a JOIN e ON e.dst = a.id WHERE hops < 3)"


@query("t_page_tree", PAGE_REACH.format(e=PAGE_TREE.replace("WHERE", "WHERE page_id > 0 AND")) + " SELECT 'children' AS relation, dst AS id, 1 AS hops FROM e WHERE src = 'page4' UNION ALL SELECT 'parent', src, 1 FROM e WHERE dst = 'page4' UNION ALL SELECT 'descendants', id, CAST(hops AS INT) FROM d WHERE hops > 0 UNION ALL SELECT 'ancestors', id, CAST(hops AS INT) FROM a WHERE hops > 0")
def _(spark, sf):
    c = rich(spark, sf)
    pages = c.pages.withColumn("id", F.concat(F.lit("page:"), "seq"))
    name = lambda k: F.concat(F.lit("page:"), F.substring(k, 5, 20))
    c = c.with_tables(pages=pages, edges=c.edges.where("kind = 'nav:child-of'").withColumns({"src": name("src"), "dst": name("dst")}))
    out = None
    for start, relation in (("page:4", "children"), ("page:4", "parent"), ("page:2", "descendants"), ("page:49", "ancestors")):
        df = traverse.relate(c, start, relation, depth=3)
        one = df.select(F.lit(relation).alias("relation"), F.replace("id", F.lit(":"), F.lit("")).alias("id"), F.col("hops") if "hops" in df.columns else F.lit(1).alias("hops"))
        out = one if out is None else out.unionByName(one)
    return out


def path_rows(spark, path: dict) -> DataFrame:
    """The hops of a path, numbered."""
    return spark.createDataFrame([(i, h["from"], h["to"], h["via"]) for i, h in enumerate(path["hops"], 1)], "hop int, src string, dst string, via string")


UPWARD = "WITH RECURSIVE e AS ({e}), r(id, up, n) AS (SELECT dst, src, 0 FROM e WHERE dst = '{end}' UNION ALL SELECT e.dst, e.src, n + 1 FROM r JOIN e ON e.dst = r.up) SELECT CAST((SELECT max(n) FROM r) - n + 1 AS INT) AS hop, up AS src, id AS dst, '{kind}' AS via FROM r"


@query("t_page_path", UPWARD.format(e=PAGE_TREE, end="page49", kind="nav:child-of"))
def _(spark, sf):
    return path_rows(spark, traverse.find_page_path(rich(spark, sf), "page0", "page49"))


SUCCESSORS = f"SELECT concat('state:', cast(floor({E} / 2) AS bigint)) AS src, concat('state:', {E}) AS dst FROM events WHERE {E} > 0"


@query("t_state_path", UPWARD.format(e=SUCCESSORS, end="state:999", kind="state:successor").replace("ON e.dst = r.up", "ON e.dst = r.up AND r.up <> 'state:1'"))
def _(spark, sf):
    return path_rows(spark, traverse.relate(rich(spark, sf), "state:1", "path", "state:999", max_hops=20))


@query("t_ax_path", "SELECT 1 AS hop, 'n3' AS src, dst, 'a11y:child-of' AS via FROM (SELECT concat('c', min(c_custkey)) AS dst FROM customer WHERE c_nationkey = 3) UNION ALL SELECT 0, 'r' || n_regionkey, 'n3', 'a11y:child-of' FROM nation WHERE n_nationkey = 3")
def _(spark, sf):
    """The shortest path from the top of the tree to a customer of the fourth nation."""
    edges, nodes = derive.tree_edges(spark, sf), derive.tree_nodes(spark, sf)
    ends = edges.where("src = 'n3' or dst = 'n3'").groupBy().agg(F.min_by("dst", F.when(F.col("src") == "n3", F.col("seq"))).alias("end"), F.min_by("src", F.when(F.col("dst") == "n3", F.col("seq"))).alias("start")).first()
    path = traverse.relate(Catalog(spark, {"ax": nodes, "edges": edges}), ends["start"], "path", ends["end"])
    return path_rows(spark, path).withColumn("hop", F.col("hop") - 1)


@query(
    "t_relate",
    f"{ROWS}, e AS ({SUCCESSORS}), r AS (SELECT dst FROM e WHERE src = 'state:5' UNION SELECT b.dst FROM e a JOIN e b ON b.src = a.dst WHERE a.src = 'state:5'), "
    "k(relation, n) AS (SELECT 'successors', count(*) FROM e WHERE src = 'state:5' UNION ALL SELECT 'predecessors', count(*) FROM e WHERE dst = 'state:5' UNION ALL SELECT 'reachable', count(*) FROM r UNION ALL SELECT 'children', 0 UNION ALL SELECT 'ancestors', 0) SELECT relation, n FROM k",
)
def _(spark, sf):
    """How many states each relation of a state gives; states form no tree."""
    c, out = rich(spark, sf), None
    for relation in ("successors", "predecessors", "reachable", "children", "ancestors"):
        one = traverse.relate(c, "state:5", relation, depth=2).agg(F.count(F.lit(1)).alias("n")).select(F.lit(relation).alias("relation"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "t_explain",
    f"{ROWS}, t AS ({derive.tree_sql()}) SELECT 'forward' AS part, dst AS id FROM t WHERE src = 'c8' UNION ALL SELECT 'backward', src FROM t WHERE dst = 'c8' UNION ALL SELECT 'page', id FROM p WHERE id = 'page8' "
    "UNION ALL SELECT 'capabilities', id FROM cap WHERE page_id = 'page8' UNION ALL SELECT 'nav', id FROM nav WHERE page_id = 'page8'",
)
def _(spark, sf):
    """Everything around an element: edges out and in, its page, that page's capabilities and navigation."""
    nodes = derive.tree_nodes(spark, sf).withColumn("page_id", F.concat(F.lit("page"), F.regexp_extract("id", "[0-9]+", 0)))
    found = traverse.explain(rich(spark, sf).with_tables(ax=nodes, edges=derive.tree_edges(spark, sf)), "c8", 1)
    out = None
    for part, column in (("forward", "to"), ("backward", "to"), ("page", "id"), ("capabilities", "id"), ("nav", "id")):
        one = found[part].select(F.lit(part).alias("part"), F.col(column).alias("id"))
        out = one if out is None else out.unionByName(one)
    return out


# tools


@query("t_tools", f"{ROWS}, k AS (SELECT *, CASE seq % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 4 END AS rank FROM cap) SELECT 'page' AS filter, id FROM k WHERE page_id = 'page5' AND rank <= 2 UNION ALL SELECT 'url', k.id FROM k JOIN p ON p.id = k.page_id AND contains(p.canonical_url, 'example.org') WHERE contains(k.name, 'ring')")
def _(spark, sf):
    """Capabilities by page and highest tier, and by URL part and name part."""
    c = rich(spark, sf)
    tier = F.element_at(F.array(*[F.lit(t) for t in govern.TIERS]), (F.col("seq") % 5 + 1).cast("int"))
    caps = c.capabilities.withColumn("security", tier)
    a = govern.tools(caps, page_id="page5", at_most="PROPOSE").select(F.lit("page").alias("filter"), "id")
    return a.unionByName(govern.tools(caps, name="ring", pages=c.pages, page_url="example.org").select(F.lit("url").alias("filter"), "id"))


@query("t_prepare_act", f"{ROWS}, k AS (SELECT *, CASE seq % 5 WHEN 0 THEN 'DISCOVER' WHEN 4 THEN 'CONFIRM' ELSE 'READ' END AS tier FROM cap) SELECT k.id, ax.role AS ax_role, tier = 'READ' AS ok, tier = 'CONFIRM' AS require_confirm FROM k LEFT JOIN ax ON ax.id = k.ax_id")
def _(spark, sf):
    """Each capability with its element's role and whether it may be invoked without confirmation."""
    c = rich(spark, sf)
    tier = F.when(F.col("seq") % 5 == 0, "DISCOVER").when(F.col("seq") % 5 == 4, "CONFIRM").otherwise("READ")
    return govern.prepare_act(c.capabilities.withColumn("security", tier), c.ax).select("id", "ax_role", "decision.ok", "decision.require_confirm")


# states and reports


@query("f_materialize", f"{ROWS} SELECT kind, count(*) AS n FROM (SELECT 'state:on-page' AS kind, id FROM st UNION ALL SELECT 'state:of-element', id FROM st UNION ALL SELECT 'state:auth', id FROM st UNION ALL SELECT 'state:visual', st.id FROM st JOIN v ON v.seq = st.seq % 50 UNION ALL SELECT 'state-feeds-capability', st.id FROM st JOIN cap ON cap.seq = st.seq % 50) GROUP BY kind")
def _(spark, sf):
    """Edges of states by kind: to pages, elements, visual nodes that exist, contexts and fed capabilities."""
    c = rich(spark, sf)
    k = (F.col("seq") % 50).cast("string")
    states = c.states.withColumns({n: F.lit(None).cast("string") for n in ("auth_role", "principal", "session")})
    elements = c.states.select(F.col("id").alias("state_id"), F.concat(F.lit("ax"), k).alias("ax_id"), F.concat(F.lit("v"), k).alias("visual_node_id"))
    return report.edge_histogram(state.materialize(states, elements, c.visual, c.capabilities))


@query("f_feeds_capability", f"{ROWS} SELECT DISTINCT st.id AS src, cap.id AS dst FROM st JOIN cap ON cap.ax_id = concat('ax', st.seq % 50)")
def _(spark, sf):
    """States and the capabilities that are bound to their elements."""
    c = rich(spark, sf)
    states = c.states.withColumns({n: F.lit(None).cast("string") for n in ("auth_role", "principal", "session")})
    elements = c.states.select(F.col("id").alias("state_id"), F.concat(F.lit("ax"), (F.col("seq") % 50).cast("string")).alias("ax_id"), F.lit(None).cast("string").alias("visual_node_id"))
    return state.materialize(states, elements, c.visual, c.capabilities).where("kind = 'state-feeds-capability'").select("src", "dst")


@query("f_auth_transitions", "SELECT DISTINCT 'auth:anonymous' AS src, concat('auth:authenticated:u', user_id, ':') AS dst FROM events WHERE event_type <> 'error' AND user_id % 4 > 0")
def _(spark, sf):
    """Causal edges from the anonymous context to others, once each."""
    e = derive.table(spark, sf, "events")
    to_kind = F.when(F.col("user_id") % 4 == 0, "anonymous").otherwise("authenticated")
    from_kind = F.when(F.col("event_type") == "error", "authenticated").otherwise("anonymous")
    none = F.lit(None).cast("string")
    who = lambda kind: state.auth_id(kind, none, F.when(kind != "anonymous", F.concat(F.lit("u"), "user_id")), none)
    steps = e.select(from_kind.alias("from_kind"), who(from_kind).alias("from_id"), to_kind.alias("to_kind"), who(to_kind).alias("to_id"), F.lit("observed").alias("provenance"))
    return state.auth_transitions(steps).select("src", "dst")


@query("r_state_rows", f"{ROWS}, e AS ({SUCCESSORS}) SELECT st.id, page_id, route, CASE WHEN seq % 2 = 0 THEN 'declared|observed' ELSE 'observed' END AS evidence, (SELECT coalesce(string_agg(dst, '|' ORDER BY CAST(substr(dst, 7) AS BIGINT)), '') FROM e WHERE src = st.id) AS successors FROM st")
def _(spark, sf):
    c = rich(spark, sf)
    seen = c.states.select(F.col("id").alias("state_id"), F.lit("observed").alias("kind"), F.lit(1).alias("seq"))
    said = c.states.where("seq % 2 = 0").select(F.col("id").alias("state_id"), F.lit("declared").alias("kind"), F.lit(0).alias("seq"))
    rows = report.state_rows(c.with_tables(state_evidence=seen.unionByName(said), edges=c.edges.where("src <> dst")))
    return rows.select("id", "page_id", "route", F.array_join("evidence_kinds", "|").alias("evidence"), F.array_join("successors", "|").alias("successors"))


@query("r_page_counts_all", f"{ROWS} SELECT p.id, (SELECT count(*) FROM ax WHERE page_id = p.id) AS ax_count, (SELECT count(*) FROM v WHERE page_id = p.id) AS visual_count, (SELECT count(*) FROM nav WHERE page_id = p.id) AS nav_count, (SELECT count(*) FROM st WHERE page_id = p.id) AS state_count, (SELECT count(*) FROM cap WHERE page_id = p.id) AS capability_count, (SELECT count(*) FROM tr JOIN ax ON ax.id = tr.from_ax_id WHERE ax.page_id = p.id) AS transition_count FROM p")
def _(spark, sf):
    return report.page_counts(rich(spark, sf)).drop("url", "title")


@query("r_failed_pages", f"{ROWS} SELECT canonical_url AS url, load_status AS status, CASE WHEN seq % 20 < 10 THEN 'first ' || seq ELSE 'Unknown page failure' END AS error FROM p WHERE load_status IN ('timeout', 'spa-error')")
def _(spark, sf):
    """Failed pages with the first error that was recorded for them."""
    c = rich(spark, sf)
    some = c.pages.where("seq % 20 < 10")
    errors = some.select(F.lit("pageErrors").alias("kind"), F.col("id").alias("page_id"), "url", F.concat(F.lit("first "), "seq").alias("message"), F.lit(1).alias("seq"))
    errors = errors.unionByName(some.select(F.lit("pageErrors").alias("kind"), F.col("id").alias("page_id"), "url", F.lit("later").alias("message"), F.lit(2).alias("seq")))
    return report.failed_pages(c.with_tables(diagnostics=errors))


@query("r_gate", f"{ROWS} SELECT (SELECT count(*) FROM p WHERE id NOT IN (SELECT page_id FROM ax)) AS pages_without_tree, (SELECT count(*) FROM events WHERE event_type = 'error') AS extractor_failures, FALSE AS ok, (SELECT count(*) FROM p WHERE id NOT IN (SELECT page_id FROM ax)) = 0 AS lenient")
def _(spark, sf):
    """The gate of an inspection, strict and lenient about failures."""
    c = rich(spark, sf)
    failures = derive.table(spark, sf, "events").where("event_type = 'error'").select(F.lit("extractorFailures").alias("kind"), F.col("event_id").alias("seq"))
    h = report.penalty_health(c.with_tables(diagnostics=failures))
    strict = report.gate(h).select("pages_without_tree", "extractor_failures", "ok")
    return strict.crossJoin(report.gate(h, 10**12).select(F.col("ok").alias("lenient")))  # one row each


@query("r_eval_summary", "SELECT count(*) FILTER (WHERE event_type = 'view') AS passed, count(*) FILTER (WHERE event_type IN ('error', 'click')) AS failed, count(*) FILTER (WHERE event_type NOT IN ('view', 'error', 'click')) AS skipped, count(*) FILTER (WHERE value > 50) AS over_budget FROM events")
def _(spark, sf):
    e = derive.table(spark, sf, "events")
    status = F.when(F.col("event_type") == "view", "passed").when(F.col("event_type").isin("error", "click"), "failed").otherwise("skipped")
    return report.eval_summary(e.select(status.alias("status"), F.col("value").alias("duration_ms"), F.lit(50.0).alias("budget_ms")))


@query("r_thresholds", f"{ROWS} SELECT (SELECT count(*) FROM p) >= 40 AS enough_pages, (SELECT count(*) FROM ax) >= 1000000000 AS enough_elements")
def _(spark, sf):
    h = report.penalty_health(rich(spark, sf))
    a = report.thresholds(h, {"minPages": 40, "maxExtractorFailures": 0}).select(F.col("pass").alias("enough_pages"))
    return a.crossJoin(report.thresholds(h, {"minAxNodes": 10**9}).select(F.col("pass").alias("enough_elements")))  # one row each


@query("v_tree_clipping", "WITH n AS (SELECT p_partkey AS k, (p_partkey * 37) % 1440 + 0.0 AS x, 20.0 + p_size AS w FROM part), c AS (SELECT k, greatest(x, 0) AS x0, least(x + w, 1440) AS x1 FROM n), d AS (SELECT c.k, greatest(c.x0, CASE WHEN c.k % 10 > 0 THEN p.x END) AS x0, least(c.x1, CASE WHEN c.k % 10 > 0 THEN p.x + p.w END) AS x1 FROM c LEFT JOIN n p ON p.k = c.k - c.k % 10) SELECT concat('v', k) AS id, CAST(greatest(0, x1 - x0) AS DOUBLE) AS clip_w FROM d")
def _(spark, sf):
    """Widths of nodes after clipping to the viewport and to a scrolling parent's padding box."""
    v = derive.visual(spark, sf)
    r, k = F.col("rect"), F.col("seq")
    box = F.struct(r["x"].alias("x"), F.lit(-1e6).alias("y"), r["w"].alias("w"), F.lit(2e6).alias("h"))
    n = v.withColumns({"padding_box": box, "is_scroll": k % 10 == 0, "is_stacking": F.lit(False), "has_children": k % 10 == 0, "z": F.lit(None).cast("int")})
    clipped = occlusion.clipped(n)
    return clipped.select("id", F.greatest(F.lit(0.0), F.col("clip.w")).alias("clip_w"))
