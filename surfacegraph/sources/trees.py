"""Captured trees of other platforms as flat accessibility rows.

Trees arrive as JSON or XML text, one a row, and leave as flat rows with the
index of the parent. Spark has no recursive types, so the flattening runs in
Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import stored
from .html import _NODES, NODES

# Roles of Windows control types and macOS roles.
WINDOWS = {
    "button": "button", "edit": "textbox", "document": "textbox", "checkbox": "checkbox", "radiobutton": "radio", "combobox": "combobox", "tab": "tablist", "tabitem": "tab",
    "datagrid": "grid", "table": "grid", "dataitem": "row", "tree": "tree", "treeitem": "treeitem", "list": "list", "listitem": "listitem", "window": "dialog", "text": "text",
    "menu": "menu", "menubar": "menu", "menuitem": "menuitem", "hyperlink": "link", "slider": "slider", "progressbar": "progressbar",
}
MACOS = {
    "button": "button", "textfield": "textbox", "textarea": "textbox", "checkbox": "checkbox", "radiobutton": "radio", "popupbutton": "combobox", "combobox": "combobox",
    "tabgroup": "tablist", "table": "grid", "row": "row", "outline": "tree", "outlineitem": "treeitem", "list": "list", "window": "dialog", "sheet": "dialog", "statictext": "text",
    "menu": "menu", "menubar": "menu", "menuitem": "menuitem", "link": "link", "slider": "slider", "progressindicator": "progressbar",
}
# Parts of Android class names and iOS types, the first that occurs counts.
ANDROID = (
    ("button", "button"), ("edittext", "textbox"), ("checkbox", "checkbox"), ("switch", "switch"), ("radiogroup", "radiogroup"), ("recyclerview", "list"), ("listview", "list"),
    ("tablayout", "tablist"), ("tabbar", "tablist"), ("dialog", "dialog"),
)
IOS = (
    ("window", "window"), ("button", "button"), ("textfield", "textbox"), ("switch", "switch"), ("table", "list"), ("collectionview", "list"), ("cell", "listitem"), ("tabbar", "tablist"),
    ("segmentedcontrol", "tablist"), ("sheet", "dialog"), ("alert", "dialog"), ("navigationbar", "navigation"), ("statictext", "text"), ("image", "img"),
)
CDP = {"rootwebarea": "document", "webarea": "document", "statictext": "text", "inlinetextbox": "text", "textfield": "textbox", "genericcontainer": "generic", "image": "img", "popupbutton": "combobox", "comboboxgrouping": "combobox", "none": "generic"}


def _first(raw: dict, *names):
    """The first field that is there and not null; names also with a capital."""
    for n in names:
        for k in (n, n[:1].upper() + n[1:]):
            if raw.get(k) is not None:
                return raw[k]
    return None


def _some(*values) -> str:
    return next((str(v) for v in values if v), "")


def windows_role(control: str) -> str:
    name = re.sub(r"(?i)ControlTypeId$", "", re.sub(r"^UIA_", "", re.sub(r"(?i)^ControlType\.", "", control or ""))).lower()
    return WINDOWS.get(name, "generic")


def macos_role(role: str) -> str:
    return MACOS.get(re.sub("^AX", "", role).lower(), "generic")


def android_role(name: str | None, clickable: bool) -> str:
    low = (name or "").lower()
    for part, role in ANDROID:
        if part in low:
            return role
    if "textview" in low or "imageview" in low:
        return "button" if clickable else "text" if "textview" in low else "img"
    return "button" if clickable else "generic"


def ios_role(kind: str) -> str:
    return next((role for part, role in IOS if part in kind.lower()), "generic")


def cdp_role(role: str) -> str:
    return CDP.get(role.lower(), role.lower() or "generic")


def _node(role, name, source, tag, element_id, states, focusable, visibility="visible", value_now=None, value_text=None) -> dict:
    base = {"expanded": None, "disabled": None, "pressed": None, "selected": None, "checked": None, "busy": False, "open": None, "current": None}
    props = dict.fromkeys(("level", "pos_in_set", "set_size", "value_min", "value_max", "live", "orientation")) | {"controls": [], "described_by": [], "labelled_by": [], "value_now": value_now, "value_text": value_text}
    return {"tag": tag, "element_id": element_id or None, "role": role, "name": name, "name_source": source, "states": base | states, "properties": props, "apg_pattern": None, "focusable": focusable, "visibility": visibility, "attrs": []}


def windows(raw: dict) -> tuple[dict, list]:
    control = _first(raw, "controlType", "localizedControlType") or "generic"
    said, ident = _first(raw, "name"), _first(raw, "automationId")
    states = {"disabled": _first(raw, "isEnabled") is False, "checked": _first(raw, "isTogglePatternOn"), "selected": _first(raw, "isSelectionItemPatternSelected"), "expanded": _first(raw, "isExpandCollapsePatternExpanded")}
    focus = _first(raw, "hasKeyboardFocus")
    node = _node(
        windows_role(control), said if said is not None else ident or "", "aria-label" if said else "implicit", (_first(raw, "className") or control).lower(), ident, states,
        True if focus is None else focus, "offscreen" if _first(raw, "isOffscreen") else "visible", None, _first(raw, "value"),
    )
    return node, _first(raw, "children") or []


def macos(raw: dict) -> tuple[dict, list]:
    role, value = macos_role(raw["role"]), raw.get("value")
    checked = value in (1, "1") or value is True
    states = {"disabled": raw.get("enabled") is False, "checked": checked if role in ("checkbox", "radio") else None, "selected": raw.get("selected"), "expanded": raw.get("expanded")}
    number = float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    source = "text-content" if raw.get("title") else "aria-label" if raw.get("description") else "implicit"
    focus = raw.get("focused")
    return _node(role, _some(raw.get("title"), raw.get("description"), raw.get("identifier")), source, raw["role"].lower(), raw.get("identifier"), states, True if focus is None else focus, "visible", number, value if isinstance(value, str) else None), raw.get("children") or []


def android(raw: dict) -> tuple[dict, list]:
    name = raw.get("className") or raw.get("class") or ""
    ident = raw.get("resourceId") or raw.get("resource_id") or raw.get("id")
    source = "aria-label" if raw.get("contentDescription") else "text-content" if raw.get("text") else "implicit"
    states = {"disabled": raw.get("enabled") is False, "checked": raw.get("checked"), "selected": raw.get("selected")}
    return _node(android_role(name, bool(raw.get("clickable"))), _some(raw.get("contentDescription"), raw.get("text"), ident), source, (name.split(".")[-1] or "view").lower(), ident, states, bool(raw.get("focused"))), raw.get("children") or []


def ios(raw: dict) -> tuple[dict, list]:
    value = raw.get("value")
    states = {"disabled": raw.get("enabled") is False, "checked": value in (1, "1") or value is True, "selected": raw.get("selected")}
    source = "aria-label" if raw.get("label") else "text-content" if raw.get("title") else "implicit"
    return _node(ios_role(raw["type"]), _some(raw.get("label"), raw.get("title"), raw.get("identifier")), source, re.sub("^XCUIElementType", "", raw["type"]).lower(), raw.get("identifier"), states, True), raw.get("children") or []


PLATFORMS: dict[str, Callable[[dict], tuple[dict, list]]] = {"windows": windows, "macos": macos, "android": android, "ios": ios}


def bounds(raw: dict) -> str | None:
    """"x,y,w,h" of a node's rectangle, however the platform writes it."""
    r = raw.get("bounds") or raw.get("frame") or raw.get("rect") or raw.get("boundingRectangle") or raw.get("BoundingRectangle")
    if not isinstance(r, dict):
        return None
    if "left" in r:
        x, y, w, h = r["left"], r["top"], r["right"] - r["left"], r["bottom"] - r["top"]
    else:
        x, y, w, h = r.get("x", 0), r.get("y", 0), r.get("w", r.get("width", 0)), r.get("h", r.get("height", 0))
    return f"{x},{y},{w},{h}"


def visual_nodes(found: DataFrame) -> DataFrame:
    """Visual nodes of a tree's elements that have a rectangle; the tree's parents are the layout parents."""
    from .html import ax_id

    # read as elements and as parents: the trees are not flattened twice
    found = stored(found.select("page_id", "element_id", "node_index", "parent_index", "role", "name", "focusable", F.col("attrs")["bounds"].alias("bounds")))
    at = F.split("bounds", ",")
    parents = found.select("page_id", F.col("node_index").alias("parent_index"), F.concat(F.lit("vis:"), "page_id", F.lit(":"), ax_id()).alias("parent"))
    boxed = found.where("bounds is not null").join(parents, ["page_id", "parent_index"], "left")
    rect = F.struct(*[at[i].cast("double").alias(k) for i, k in enumerate("xywh")])
    style = F.create_map(F.lit("cursor"), F.when(F.col("role").isin("button", "link"), "pointer").otherwise("auto"), F.lit("position"), F.when(F.col("role") == "dialog", "absolute").otherwise("static"))
    return boxed.select(
        F.concat(F.lit("vis:"), "page_id", F.lit(":"), ax_id()).alias("id"), ax_id().alias("ax_id"), "page_id", rect.alias("rect"), style.alias("style"), "parent", "role", "name", "focusable",
        F.lit(None).cast("string").alias("container_type"), F.col("node_index").cast("long").alias("seq"),
    )


def flatten(root: dict, read: Callable[[dict], tuple[dict, list]]) -> list[dict]:
    """Nodes in pre-order with their parents' numbers."""
    out, stack = [], [(root, None)]
    while stack:
        raw, parent = stack.pop()
        node, kids = read(raw)
        if box := bounds(raw):
            node["attrs"] = [("bounds", box)]
        index = len(out)
        out.append(node | {"node_index": index, "parent_index": parent})
        stack.extend((k, index) for k in reversed(kids if isinstance(kids, list) else []))
    return out


def android_xml(text: str) -> dict:
    """The node tree of a UI dump; empty texts are absent; bounds are left, top, right, bottom."""
    def read(e: ElementTree.Element) -> dict:
        a = e.attrib
        flag = lambda k: {"true": True, "false": False}.get(a.get(k, ""))
        b = re.match(r"\[(-?\d+),(-?\d+)\]\[(-?\d+),(-?\d+)\]", a.get("bounds", ""))
        return {
            "className": a.get("class") or None, "text": a.get("text") or None, "contentDescription": a.get("content-desc") or None, "resourceId": a.get("resource-id") or None,
            **{k: flag(k) for k in ("clickable", "enabled", "focused", "checked", "selected", "scrollable")},
            "bounds": dict(zip(("left", "top", "right", "bottom"), map(int, b.groups()), strict=True)) if b else None, "children": [read(c) for c in e if c.tag == "node"],
        }

    root = ElementTree.fromstring(text.strip())
    return read(root) if root.tag == "node" else {"className": "hierarchy", "children": [read(c) for c in root if c.tag == "node"]}


def trees(dumps: DataFrame, platform: str) -> DataFrame:
    """Flat rows of dumps (page_id, url, tree): JSON trees of a platform, or ``android-xml``."""
    xml = platform == "android-xml"
    read = PLATFORMS["android" if xml else platform]

    def run(batches):
        for b in batches:
            held = []
            for page, url, tree in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if tree:
                    held += [r | {"page_id": page, "url": url} for r in flatten(android_xml(tree) if xml else json.loads(tree), read)]
            yield pa.RecordBatch.from_pylist(held, schema=_NODES)

    return dumps.select("page_id", "url", "tree").mapInArrow(run, NODES)


def cdp(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, parent_id, role, name): a flat protocol tree with known roles, without ignored nodes.

    A node whose parent is ignored hangs on its nearest kept ancestor. ``nodes``:
    page_id, node_id, parent_id, role, name, ignored, seq.
    """
    role = F.lower("role")
    mapped = F.coalesce(F.create_map(*[F.lit(x) for kv in CDP.items() for x in kv])[role], F.when(role == "", "generic").otherwise(role))
    up = nodes.select("page_id", F.col("node_id").alias("parent_id"), F.col("parent_id").alias("_next"), F.coalesce("ignored", F.lit(False)).alias("_gone"))
    kept = nodes.where(~F.coalesce("ignored", F.lit(False))).withColumn("role", mapped)
    for _ in range(32):
        step = kept.join(up, ["page_id", "parent_id"], "left")
        kept = step.withColumn("_skip", F.coalesce("_gone", F.lit(False))).withColumn("parent_id", F.when(F.col("_skip"), F.col("_next")).otherwise(F.col("parent_id"))).drop("_next", "_gone")
        if kept.where("_skip").isEmpty():
            break
        kept = kept.drop("_skip")
    order = F.row_number().over(Window.partitionBy("page_id").orderBy("seq")) - 1
    return kept.select("page_id", "node_id", "parent_id", "role", "name", order.alias("node_index"))
