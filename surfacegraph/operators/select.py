"""Declarative selection: a request is compiled to column predicates and semi-joins.

All predicates hold together; one that does not concern a kind is ignored for
it. Reachability is computed once, as a set, and becomes a semi-join.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import rect, touches
from ..functions.js import is_, yes
from ..plans.catalog import Catalog
from ..plans.schema import ANY_ORDER, KINDS
from .traverse import reachable

DEFAULT_LIMIT = 50
MOST_ROWS = 1000


@dataclass
class Where:
    """Conditions of a request. Text is a part to contain, a ``re.Pattern``, or {source, flags}."""

    page_url: Any = None
    role: Any = None
    name: Any = None
    state: dict | None = None
    has_capability: str | None = None
    design_token: str | None = None
    in_tether: dict | None = None
    within_viewport: dict | None = None
    reachable_from: dict | None = None
    visual_style: dict | None = None
    viewport: Any = None
    visual_hidden_at_viewport: str | None = None
    is_visual_container: bool | None = None
    container_type: Any = None
    is_scroll_container: bool | None = None
    is_stacking_context: bool | None = None
    has_transform: bool | None = None
    box_sizing: str | None = None
    is_occluded: bool | None = None
    min_visible_ratio: float | None = None
    max_visible_ratio: float | None = None
    is_offscreen: bool | None = None
    visual_pattern: Any = None
    has_pattern: bool | None = None
    is_fab: bool | None = None
    is_modal_backdrop: bool | None = None
    is_sticky_header: bool | None = None
    is_sticky_footer: bool | None = None
    is_dismiss_button: bool | None = None
    is_form_group: bool | None = None
    has_token_binding: bool | None = None
    token_path: str | None = None
    has_token_drift: bool | None = None
    drift_severity: str | None = None
    nav_kind: Any = None
    nav_in_page: str | None = None
    state_on_page: str | None = None
    state_auth_kind: str | None = None
    state_network_evidence: str | None = None
    state_has_open_dialog: str | None = None
    state_has_open_popover: str | None = None
    state_route: Any = None

    @classmethod
    def parse(cls, where: Where | dict | None) -> Where:
        """From a dictionary with snake_case or camelCase keys; unknown keys are refused."""
        if isinstance(where, cls):
            return where
        names = {f.name for f in fields(cls)}
        out = {}
        for k, v in (where or {}).items():
            name = re.sub(r"(?<=[a-z])([A-Z])", lambda m: "_" + m[1].lower(), k)
            if name not in names:
                raise ValueError(f"unknown condition: {k}")
            out[name] = v
        return cls(**out)


def as_list(v: Any) -> list:
    return list(v) if isinstance(v, (list, tuple, set)) else [v]


def text(c: Column, p: Any) -> Column:
    """Contains the part, or matches the pattern anywhere. Null matches nothing."""
    if isinstance(p, re.Pattern):
        p = {"source": p.pattern, "flags": "i" if p.flags & re.IGNORECASE else ""}
    if isinstance(p, dict):
        flags = "".join(f for f in "ims" if f in p.get("flags", ""))
        hit = c.rlike((f"(?{flags})" if flags else "") + p["source"])
    else:
        hit = F.contains(c, F.lit(p))
    return F.coalesce(hit, F.lit(False))


def glob(c: Column, p: str) -> Column:
    """``*x`` ends, ``x*`` starts, ``*x*`` and ``x`` contain; case does not count."""
    low, start, end = F.lower(c), p.startswith("*"), p.endswith("*")
    if start and end:
        return F.contains(low, F.lit(p[1:-1].lower()))
    if start:
        return F.endswith(low, F.lit(p[1:].lower()))
    if end:
        return F.startswith(low, F.lit(p[:-1].lower()))
    return F.contains(low, F.lit(p.lower()))


class Compiler:
    """Filters the tables of a catalog by a request's conditions."""

    def __init__(self, catalog: Catalog, where: Where | dict | None):
        self.c = catalog
        self.w = Where.parse(where)

    # each kind

    def pages(self) -> DataFrame:
        df = self.c.pages
        if self.w.page_url:
            df = df.where(text(F.col("canonical_url"), self.w.page_url))
        return df.where(text(F.col("title"), self.w.name)) if self.w.name else df

    def _on_pages(self, df: DataFrame, column: str = "page_id") -> DataFrame:
        if not self.w.page_url:
            return df
        ok = self.c.pages.where(text(F.col("canonical_url"), self.w.page_url)).select(F.col("id").alias("_page"))
        return df.join(ok, F.col(column) == F.col("_page"), "left_semi")

    def ax(self) -> DataFrame:
        w = self.w
        df = self._ax_own(self._on_pages(self.c.ax))
        for k, v in (w.state or {}).items():
            got = F.col("states")[k]
            df = df.where(got.isNull() if v is None else is_(got, str(v).lower() if k == "current" and isinstance(v, bool) else v))
        if w.has_capability:
            able = self.c.capabilities.where(glob(F.col("name"), w.has_capability)).select(F.col("page_id").alias("_page"))
            df = df.join(able, F.col("page_id") == F.col("_page"), "left_semi")
        df = self._reached(df, "id")
        if self._visual_conditions(shared_only=True):
            seen = self._visual_own(self.c.primary_visual(), shared_only=True).select(F.col("ax_id").alias("_ax"))
            df = df.join(seen, F.col("id") == F.col("_ax"), "left_semi")
        return df

    def _ax_own(self, df: DataFrame) -> DataFrame:
        if self.w.role:
            df = df.where(F.col("role").isin(as_list(self.w.role)))
        return df.where(text(F.col("name"), self.w.name)) if self.w.name else df

    def _reached(self, df: DataFrame, column: str) -> DataFrame:
        r = self.w.reachable_from
        if not r:
            return df
        hops = r.get("maxHops", r.get("max_hops", 5))
        ids = reachable(self.c.edges, r.get("axId", r.get("ax_id")), r.get("via"), hops).select(F.col("id").alias("_reached"))
        return df.join(ids, F.col(column) == F.col("_reached"), "left_semi")

    def visual(self) -> DataFrame:
        known = self.c.pages.select(F.col("id").alias("_page"))
        df = self._on_pages(self.c.visual.join(known, F.col("page_id") == F.col("_page"), "left_semi"))
        if self.w.role or self.w.name:
            named = self._ax_own(self.c.ax).select(F.col("id").alias("_ax"))
            df = df.join(named, F.col("ax_id") == F.col("_ax"), "left_semi")
        return self._visual_own(self._reached(df, "ax_id"), shared_only=False)

    def _visual_conditions(self, shared_only: bool) -> bool:
        own = {"visual_style", "has_token_binding", "token_path", "has_token_drift", "drift_severity"}
        names = [f.name for f in fields(Where)]
        visual = names[names.index("design_token") : names.index("nav_kind")]
        return any(getattr(self.w, n) is not None for n in visual if n != "reachable_from" and not (shared_only and n in own))

    def _visual_own(self, df: DataFrame, shared_only: bool) -> DataFrame:
        w = self.w
        if w.design_token:
            df = df.where(F.coalesce(F.array_contains("refs", w.design_token), F.lit(False)))
        if w.in_tether:
            df = self._tethered(df, w.in_tether)
        if w.within_viewport:
            v = w.within_viewport
            df = df.where(touches(F.col("rect"), rect(*[F.lit(float(v[k])) for k in "xywh"])))
        if w.viewport is not None:
            df = self._at_viewport(df, w.viewport)
        if w.visual_hidden_at_viewport:
            df = self._hidden_at(df, w.visual_hidden_at_viewport)
        for name, column in (("is_visual_container",) * 2, ("is_scroll_container",) * 2, ("is_stacking_context",) * 2, ("has_transform",) * 2, ("is_occluded", "occlusion.is_occluded"), ("is_offscreen", "occlusion.is_offscreen")):
            if getattr(w, name) is not None:
                df = df.where(yes(column) == F.lit(getattr(w, name)))
        if w.container_type is not None:
            df = df.where(F.coalesce(F.col("container_type").isin(as_list(w.container_type)), F.lit(False)))
        if w.box_sizing is not None:
            df = df.where(is_("box_sizing", w.box_sizing))
        ratio = F.coalesce("occlusion.visible_ratio", F.lit(1.0))
        if w.min_visible_ratio is not None:
            df = df.where(ratio >= w.min_visible_ratio)
        if w.max_visible_ratio is not None:
            df = df.where(ratio <= w.max_visible_ratio)
        shown = F.coalesce(F.transform("patterns", lambda p: p["pattern"]), F.array().cast("array<string>"))
        if w.visual_pattern is not None:
            df = df.where(F.arrays_overlap(shown, F.array(*[F.lit(p) for p in as_list(w.visual_pattern)])))
        if w.has_pattern is not None:
            df = df.where((F.size(shown) > 0) == F.lit(w.has_pattern))
        for name in ("fab", "modal_backdrop", "sticky_header", "sticky_footer", "dismiss_button", "form_group"):
            v = getattr(w, f"is_{name}")
            if v is not None:
                df = df.where(F.array_contains(shown, name.replace("_", "-")) == F.lit(v))
        if shared_only:
            return df
        for k, v in (w.visual_style or {}).items():
            df = df.where(is_(F.col("style")[k], v))
        some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
        none = F.array().cast("array<string>")
        if w.has_token_binding is not None:
            df = df.where((some("bindings") | some("refs")) == F.lit(w.has_token_binding))
        if w.token_path is not None:
            df = df.where(F.array_contains(F.concat(F.coalesce("bindings", none), F.coalesce("refs", none)), w.token_path))
        if w.has_token_drift is not None:
            df = df.where(some("drift_severities") == F.lit(w.has_token_drift))
        if w.drift_severity is not None:
            df = df.where(F.coalesce(F.array_contains("drift_severities", w.drift_severity), F.lit(False)))
        return df

    def _tethered(self, df: DataFrame, t: dict) -> DataFrame:
        """Relation to the node of ``axId``: children, parent, siblings or anchors."""
        ax_id, relation = t.get("axId", t.get("ax_id")), t.get("relation")
        if relation == "anchors":
            return df.where(F.coalesce(F.exists("tethers.anchors", lambda a: a["target"] == ax_id), F.lit(False)))
        target = self.c.visual_by_ax(ax_id).select(F.col("id").alias("_t"), F.col("tethers.parent").alias("_tp"))
        on = {
            "children": F.col("tethers.parent") == F.col("_t"),
            "parent": F.col("id") == F.col("_tp"),
            "siblings": (F.col("tethers.parent") == F.col("_tp")) & (F.col("id") != F.col("_t")),
        }
        return df.join(target, on[relation], "left_semi")

    @staticmethod
    def _fits(v: Column, wanted: Any) -> Column:
        hit = F.lower(v["name"]) == wanted.lower() if isinstance(wanted, str) else v["w"] == float(wanted["w"])
        return F.coalesce(hit, F.lit(False))

    def _at_viewport(self, df: DataFrame, wanted: Any) -> DataFrame:
        seen = self.c.observations.where(self._fits(F.col("viewport"), wanted)).select(F.col("ax_id").alias("_ax"), F.lit(True).alias("_seen")).distinct()
        return df.join(seen, F.col("ax_id") == F.col("_ax"), "left").where(self._fits(F.col("viewport"), wanted) | yes("_seen")).drop("_ax", "_seen")

    def _hidden_at(self, df: DataFrame, name: str) -> DataFrame:
        hidden = F.col("visibility").isin("hidden", "display-none") | (F.col("style")["display"] == "none") | (F.col("style")["visibility"] == "hidden")
        at = self.c.observations.where((F.lower("viewport.name") == name.lower()) & F.coalesce(hidden, F.lit(False)))
        return df.join(at.select(F.col("ax_id").alias("_ax")), F.col("ax_id") == F.col("_ax"), "left_semi")

    def edges(self) -> DataFrame:
        """Edges that leave a known element."""
        sources = self._on_pages(self.c.ax).select(F.col("id").alias("_ax"))
        return self.c.edges.join(sources, F.col("src") == F.col("_ax"), "left_semi")

    def capabilities(self) -> DataFrame:
        df = self._on_pages(self.c.capabilities)
        for p in (self.w.name, self.w.has_capability):
            df = df.where(text(F.col("name"), p)) if p else df
        return df

    def transitions(self) -> DataFrame:
        if not self.w.page_url:
            return self.c.transitions
        sources = self._on_pages(self.c.ax).select(F.col("id").alias("_ax"))
        return self.c.transitions.join(sources, F.col("from_ax_id") == F.col("_ax"), "left_semi")

    def nav(self) -> DataFrame:
        known = self.c.pages.select(F.col("id").alias("_page"))
        df, w = self.c.nav.join(known, F.col("page_id") == F.col("_page"), "left_semi"), self.w
        if w.nav_in_page:
            df = df.where(F.col("page_id") == w.nav_in_page)
        if w.nav_kind:
            df = df.where(F.col("kind").isin(as_list(w.nav_kind)))
        return df.where(text(F.col("name"), w.name)) if w.name else df

    def states(self) -> DataFrame:
        df, w = self.c.states, self.w
        for column, value in (("page_id", w.state_on_page), ("auth_kind", w.state_auth_kind), ("network_evidence", w.state_network_evidence)):
            df = df.where(F.col(column) == value) if value else df
        for column, value in (("open_dialog_ids", w.state_has_open_dialog), ("open_popover_ids", w.state_has_open_popover)):
            df = df.where(F.array_contains(column, value)) if value else df
        return df.where(text(F.col("route"), w.state_route)) if w.state_route else df


def select(catalog: Catalog, kind: str, where: Where | dict | None = None) -> DataFrame:
    """All rows of a kind that fit, in no order."""
    return getattr(Compiler(catalog, where), KINDS.get(kind, kind))()


def query(catalog: Catalog, kind: str = "any", where: Where | dict | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(rank, kind, seq, id, node): the first ``limit`` + 1 hits in order; ``node`` is JSON.

    ``any`` concatenates the kinds, and the limit spans them. Visual and nav
    nodes come page by page. A row beyond the limit tells that there are more.
    """
    names = {v: k for k, v in KINDS.items()}
    tables = ANY_ORDER if kind == "any" else (KINDS[kind],)
    compiler = Compiler(catalog, where)
    out = None
    for rank, name in enumerate(tables):
        df = getattr(compiler, name)()
        page = F.lit(0).cast("long")
        if name in ("visual", "nav"):
            order = catalog.pages.select(F.col("id").alias("_p"), F.col("seq").alias("_page_seq"))
            df = df.join(order, F.col("page_id") == F.col("_p"))
            page = F.col("_page_seq")
        own = F.to_json(F.struct(*[c for c in getattr(catalog, name).columns]))
        one = df.select(F.lit(rank).alias("rank"), F.lit(names[name]).alias("kind"), page.alias("page_seq"), "seq", "id", own.alias("node"))
        out = one if out is None else out.unionByName(one)
    return out.orderBy("rank", "page_seq", "seq", "id").limit(limit + 1).drop("page_seq")


def hits(catalog: Catalog, kind: str = "any", where: Where | dict | None = None, limit: int = DEFAULT_LIMIT) -> dict:
    """The bounded answer of a request: hits, whether there are more, and how many (-1: unknown)."""
    import json

    limit = min(limit, MOST_ROWS)
    rows = query(catalog, kind, where, limit).collect()
    more = len(rows) > limit
    return {"hits": [{"select": r["kind"], "node": json.loads(r["node"])} for r in rows[:limit]], "truncated": more, "remaining": -1 if more else 0}
