"""Accessibility nodes, relations and links from captured HTML.

Pages are parsed in Arrow batches, one page at a time; a page's tree never
leaves its task. Nodes carry the index of their parent, so trees are flat rows.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import SPACE, canonical_url, fnv1a_32, href_kind, resolve_url, slug
from ..operators.govern import tier
from ..plans.catalog import last_wins
from ..plans.lineage import small_batches, stored

# Roles that elements have without saying so.
ROLES = {
    "nav": "navigation", "main": "main", "aside": "complementary", "header": "banner", "footer": "contentinfo", "form": "form", "search": "search",
    "article": "article", "section": "region", "address": "group", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading",
    "h6": "heading", "ul": "list", "ol": "list", "dl": "list", "li": "listitem", "dt": "term", "dd": "definition", "table": "table", "thead": "rowgroup",
    "tbody": "rowgroup", "tfoot": "rowgroup", "tr": "row", "th": "columnheader", "td": "cell", "caption": "caption", "button": "button", "select": "combobox",
    "textarea": "textbox", "output": "status", "progress": "progressbar", "meter": "progressbar", "details": "group", "summary": "button", "dialog": "dialog",
    "fieldset": "group", "legend": "legend", "figure": "figure", "figcaption": "caption", "hr": "separator", "img": "img", "area": "link", "mark": "mark",
}
INPUT_ROLES = {
    "button": "button", "submit": "button", "reset": "button", "image": "button", "file": "button", "checkbox": "checkbox", "radio": "radio",
    "range": "slider", "number": "spinbutton", "search": "searchbox", "hidden": None,
}
LABELABLE = ("input", "textarea", "select", "button", "meter", "output", "progress")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
APG = {
    "tab": "tabs", "dialog": "dialog", "alertdialog": "dialog", "listbox": "listbox", "option": "listbox", "menu": "menu", "menubar": "menu", "menuitem": "menu",
    "menuitemcheckbox": "menu", "menuitemradio": "menu", "combobox": "combobox", "tree": "tree", "treeitem": "tree", "grid": "grid", "gridcell": "grid", "row": "grid",
}
INTERACTIVE_TAGS = ("a", "button", "input", "select", "textarea", "summary")
INTERACTIVE_ROLES = ("button", "link", "textbox", "searchbox", "combobox", "listbox", "checkbox", "radio", "switch", "tab", "menuitem", "slider", "spinbutton", "option")
#: An element that opens closes these, as browsers do.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
BLOCKS = frozenset("address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
STOPS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}


class Element:
    __slots__ = ("attrs", "kids", "order", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None, order: int):
        self.tag, self.attrs, self.parent, self.order, self.kids = tag, attrs, parent, order, []

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.kids))
        return "".join(out)


class Tree(HTMLParser):
    """Elements of a document in order; unclosed elements end where their parents do."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.open: list[Element] = []
        self.feed(html or "")
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "head", "body") and any(e.tag == tag for e in self.open):
            return
        if tag in BLOCKS and tag != "p":
            self._end({"p"}, ("div", "section", "article", "main", "td", "li"))
        if tag in CLOSES:
            self._end(CLOSES[tag], STOPS.get(tag, ("div", "section", "article", "main", "td", "li", "select")))
        first: dict[str, str] = {}
        for k, v in attrs:
            first.setdefault(k, v if v is not None else "")
        e = Element(tag, first, self.open[-1] if self.open else None, len(self.elements))
        if self.open:
            self.open[-1].kids.append(e)
        self.elements.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.open and self.open[-1].tag == tag and tag not in VOID and tag in ("svg", "path", "use"):
            self.open.pop()

    def _end(self, tags: set[str], stops: tuple[str, ...]) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in stops:
                return

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if self.open:
            self.open[-1].kids.append(data)


def squeeze(s: str | None) -> str:
    return SPACE.sub(" ", s or "").strip()


def role_of(e: Element) -> str | None:
    said = e.attrs.get("role", "").strip().lower()
    if said:
        return said
    if e.tag == "input":
        return INPUT_ROLES.get((e.attrs.get("type") or "text").lower(), "textbox")
    if e.tag == "a":
        return "link" if "href" in e.attrs else "generic"
    if e.tag == "img" and e.attrs.get("alt") == "":
        return "presentation"
    return ROLES.get(e.tag)


def name_of(e: Element, by_id: dict[str, Element], labels: dict[str, list[Element]]) -> tuple[str, str]:
    """(accessible name, where it comes from), by the order of precedence."""
    parts = [by_id[i].text() for i in e.attrs.get("aria-labelledby", "").split() if i in by_id]
    if joined := squeeze(" ".join(parts)):
        return joined, "aria-labelledby"
    if label := squeeze(e.attrs.get("aria-label")):
        return label, "aria-label"
    if e.tag in LABELABLE:
        around, up = [], e.parent
        while up is not None and not around:
            around = [up] if up.tag == "label" else []
            up = up.parent
        for owner in [*labels.get(e.attrs.get("id", ""), []), *around]:
            if text := squeeze(owner.text()):
                return text, "label"
    for tags, attr, source in ((("img", "area"), "alt", "alt"), (("input", "textarea"), "placeholder", "placeholder"), (None, "title", "title")):
        if (tags is None or e.tag in tags) and (value := squeeze(e.attrs.get(attr))):
            return value, source
    return squeeze(e.text()), "content"


def _tri(v: str | None) -> bool | None:
    return {"true": True, "mixed": True, "false": False}.get((v or "").lower()) if v is not None else None


def _int(v: str | None) -> float | None:
    m = re.match(r"\s*([-+]?\d+)", v or "")
    return float(m[1]) if m else None


def states_of(e: Element) -> dict:
    a = e.attrs
    current = a.get("aria-current")
    if current is not None:
        low = current.lower()
        current = low if low in ("false", "page", "step", "location", "date", "time") else "true"
    expanded = {"true": True, "false": False}.get(a["aria-expanded"].lower()) if "aria-expanded" in a else ("open" in a if e.tag == "details" else None)
    said = a.get("aria-disabled")
    return {
        "expanded": expanded, "disabled": True if "disabled" in a or said == "true" else False if said == "false" else None,
        "pressed": _tri(a.get("aria-pressed")), "selected": _tri(a.get("aria-selected")), "checked": _tri(a.get("aria-checked")), "busy": _tri(a.get("aria-busy")),
        "open": "open" in a if e.tag == "dialog" or "popover" in a else None, "current": current,
    }


def properties_of(e: Element) -> dict:
    a = e.attrs
    word = lambda k, ok: a[k].lower() if k in a and a[k].lower() in ok else None
    level = float(e.tag[1]) if re.fullmatch("h[1-6]", e.tag) else _int(a.get("aria-level"))
    return {
        "controls": a.get("aria-controls", "").split(), "described_by": a.get("aria-describedby", "").split(), "labelled_by": a.get("aria-labelledby", "").split(),
        "level": level, "pos_in_set": _int(a.get("aria-posinset")), "set_size": _int(a.get("aria-setsize")), "value_now": _int(a.get("aria-valuenow")),
        "value_min": _int(a.get("aria-valuemin")), "value_max": _int(a.get("aria-valuemax")), "live": word("aria-live", ("polite", "assertive", "off")),
        "orientation": word("aria-orientation", ("horizontal", "vertical")), "value_text": a.get("aria-valuetext"),
    }


def focusable(e: Element) -> bool:
    a = e.attrs
    if "tabindex" in a and _int(a["tabindex"]) is not None:
        return True
    if e.tag == "input" and (a.get("type") or "text").lower() == "hidden":
        return False
    if e.tag in ("input", "textarea", "select", "button"):
        return "disabled" not in a
    if e.tag in ("a", "area"):
        return "href" in a
    return e.tag in ("summary", "details", "dialog", "iframe") or a.get("contenteditable", "false") != "false"


def visibility(e: Element) -> str:
    style = e.attrs.get("style", "").replace(" ", "").lower()
    if "hidden" in e.attrs:
        return "hidden"
    return "display-none" if "display:none" in style else "hidden" if "visibility:hidden" in style or "visibility:collapse" in style else "visible"


_STATES = pa.struct([(k, pa.bool_()) for k in ("expanded", "disabled", "pressed", "selected", "checked", "busy", "open")] + [("current", pa.string())])
_PROPS = pa.struct(
    [(k, pa.list_(pa.string())) for k in ("controls", "described_by", "labelled_by")]
    + [(k, pa.float64()) for k in ("level", "pos_in_set", "set_size", "value_now", "value_min", "value_max")]
    + [(k, pa.string()) for k in ("live", "orientation", "value_text")]
)
_NODES = pa.schema(
    [("page_id", pa.string()), ("url", pa.string()), ("node_index", pa.int32()), ("parent_index", pa.int32()), ("tag", pa.string()), ("element_id", pa.string()), ("role", pa.string()), ("name", pa.string()),
     ("name_source", pa.string()), ("states", _STATES), ("properties", _PROPS), ("apg_pattern", pa.string()), ("focusable", pa.bool_()), ("visibility", pa.string()), ("attrs", pa.map_(pa.string(), pa.string()))]
)
NODES = (
    "page_id string, url string, node_index int, parent_index int, tag string, element_id string, role string, name string, name_source string, "
    "states struct<expanded:boolean,disabled:boolean,pressed:boolean,selected:boolean,checked:boolean,busy:boolean,open:boolean,current:string>, "
    "properties struct<controls:array<string>,described_by:array<string>,labelled_by:array<string>,level:double,pos_in_set:double,set_size:double,value_now:double,value_min:double,value_max:double,live:string,orientation:string,value_text:string>, "
    "apg_pattern string, focusable boolean, visibility string, attrs map<string,string>"
)
#: Attributes that later steps read.
KEPT = ("href", "id", "role", "for", "type", "commandfor", "command", "popovertarget", "popovertargetaction", "popover", "aria-owns", "aria-flowto", "aria-flowsto", "data-cap", "aria-haspopup", "value", "selected")


def page_rows(html: str) -> list[dict]:
    tree = Tree(html)
    by_id: dict[str, Element] = {}
    labels: dict[str, list[Element]] = {}
    for e in tree.elements:
        if e.attrs.get("id"):
            by_id.setdefault(e.attrs["id"], e)
        if e.tag == "label" and e.attrs.get("for"):
            labels.setdefault(e.attrs["for"], []).append(e)
    rows = []
    for e in tree.elements:
        role = role_of(e)
        name, source = name_of(e, by_id, labels)
        apg = APG.get(role or "")
        if apg is None and "aria-expanded" in e.attrs:
            apg = {"button": "disclosure", "heading": "accordion"}.get(role or "")
        rows.append(
            {
                "node_index": e.order, "parent_index": e.parent.order if e.parent else None, "tag": e.tag, "element_id": e.attrs.get("id") or None, "role": role or "presentation", "name": name,
                "name_source": source, "states": states_of(e), "properties": properties_of(e), "apg_pattern": apg, "focusable": focusable(e), "visibility": visibility(e),
                "attrs": [(k, e.attrs[k]) for k in KEPT if k in e.attrs],
            }
        )
    return rows


def nodes(pages: DataFrame) -> DataFrame:
    """A row for each element of each page, in document order. ``pages``: page_id, url, html."""

    small_batches(pages.sparkSession)

    def run(batches):
        for b in batches:
            held: list[dict] = []
            columns = [b.column(i) for i in range(3)]
            for n in range(b.num_rows):  # one page at a time is text and tree
                page, url, html = (c[n].as_py() for c in columns)
                held += [r | {"page_id": page, "url": url} for r in page_rows(html)]
                if len(held) >= 1000:
                    yield pa.RecordBatch.from_pylist(held, schema=_NODES)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=_NODES)
            pa.default_memory_pool().release_unused()

    return pages.select("page_id", "url", "html").mapInArrow(run, NODES)


def ax_id(element_id: str | Column = "element_id", index: str | Column = "node_index") -> Column:
    e, i = (F.col(c) if isinstance(c, str) else c for c in (element_id, index))
    return F.concat(F.lit("ax:"), "page_id", F.lit(":"), F.coalesce(F.nullif(e, F.lit("")), F.concat(F.lit("n"), i.cast("string"))))


def ax_table(found: DataFrame) -> DataFrame:
    """The catalog's accessibility nodes. An id used twice on a page belongs to its last element."""
    parents = found.select("page_id", F.col("node_index").alias("parent_index"), ax_id().alias("parent_ax_id"))
    rows = found.join(parents, ["page_id", "parent_index"], "left").select(
        ax_id().alias("id"), "page_id", "role", "name", "name_source", "states", "properties", "apg_pattern", "focusable", "visibility",
        F.col("node_index").alias("in_page_dom_order"), "parent_ax_id", F.lit("html:walker").alias("provenance"), F.col("node_index").cast("long").alias("seq"),
    )
    return last_wins(rows, "id")


def structure_edges(found: DataFrame) -> DataFrame:
    """Edges of the tree (parent to child), of aria references, and of attributes that name other elements."""
    has_id = F.col("element_id").isNotNull()
    words = lambda k: F.filter(F.split(F.coalesce(F.col("attrs")[k], F.lit("")), r"\s+"), lambda x: x != "")
    lists = [("aria-controls", F.col("properties.controls")), ("aria-describedBy", F.col("properties.described_by")), ("aria-labelledBy", F.col("properties.labelled_by"))]
    lists += [(kind, F.when(has_id, words(attr))) for kind, attr in (("aria-owns", "aria-owns"), ("aria-flowsto", "aria-flowsto"), ("commandfor", "commandfor"), ("popovertarget", "popovertarget"))]
    none = F.array().cast("array<string>")
    said = lambda n, kind, to: F.transform(F.coalesce(to, none), lambda r: F.struct(r.alias("ref"), F.lit(kind).alias("kind"), F.lit(n).alias("part")))
    refs = F.flatten(F.array(*[said(n, kind, to) for n, (kind, to) in enumerate(lists, 1)]))
    # read three times; pages are parsed once
    read = stored(found.select("page_id", "node_index", "parent_index", ax_id().alias("me"), refs.alias("refs")))
    parents = read.select("page_id", F.col("node_index").alias("parent_index"), F.col("me").alias("p"))
    tree = read.join(parents, ["page_id", "parent_index"]).select(F.col("p").alias("src"), F.col("me").alias("dst"), F.lit("a11y:child-of").alias("kind"), "node_index", F.lit(0).alias("part"))
    named = read.select("me", "page_id", "node_index", F.explode("refs").alias("r"))
    out = tree.unionByName(named.select(F.col("me").alias("src"), F.concat(F.lit("ax:"), "page_id", F.lit(":"), "r.ref").alias("dst"), "r.kind", "node_index", "r.part"))
    return _edges(out)


def _edges(rows: DataFrame) -> DataFrame:
    edges = rows.select(
        F.concat(F.lit("edge:"), "src", F.lit("->"), "dst", F.lit(":"), "kind").alias("id"), "src", "dst", "kind", F.lit("html:walker").alias("provenance"),
        (F.col("node_index").cast("long") * 16 + F.col("part")).alias("seq"),
    )
    return last_wins(edges)


def links(found: DataFrame) -> DataFrame:
    """(page_id, url, from_ax_id, to_ax_id, raw_href, href, link_kind, node_index): links of pages, in document order."""
    raw = F.col("attrs")["href"]
    a = found.where((F.col("tag").isin("a", "area") | (F.lower(F.trim(F.col("attrs")["role"])) == "link")) & (raw != "")).select("page_id", "url", "element_id", "node_index", raw.alias("raw_href"))
    a = a.withColumn("href", F.when(~F.startswith("raw_href", F.lit("#")) & ~F.startswith(F.lower("raw_href"), F.lit("javascript:")), resolve_url("raw_href", "url")))
    a = a.withColumn("link_kind", href_kind("raw_href", F.coalesce("href", F.lit("")), "url"))
    page = F.concat(F.lit("ax:"), "page_id", F.lit(":"))
    at = F.when(F.col("link_kind") == "external", "external:").when(F.col("link_kind") == "javascript", "js:").otherwise("href:")
    return a.select(
        "page_id", "url", F.concat(page, F.coalesce("element_id", F.concat(F.lit("href:"), "raw_href"))).alias("from_ax_id"), F.concat(page, at, "raw_href").alias("to_ax_id"),
        "raw_href", "href", "link_kind", "node_index",
    )


def link_edges(found_links: DataFrame) -> DataFrame:
    rows = found_links.select(F.col("from_ax_id").alias("src"), F.col("to_ax_id").alias("dst"), F.lit("link").alias("kind"), "node_index", F.lit(15).alias("part"))
    return _edges(rows)


def nav_links(found_links: DataFrame, pages: DataFrame) -> DataFrame:
    """(src, dst): pages joined by a link, each pair once, without loops. ``pages``: id, canonical_url."""
    out = found_links.where((F.col("link_kind").isin("same-origin", "external")) & F.col("href").isNotNull()).where("link_kind = 'same-origin'")
    to = out.select(F.col("page_id").alias("src"), canonical_url("href").alias("canonical_url")).distinct()
    return to.join(pages.select(F.col("id").alias("dst"), "canonical_url"), "canonical_url").where("src <> dst").select("src", "dst").distinct()


def capabilities(found: DataFrame) -> DataFrame:
    """Capabilities of interactive elements: named by their slug, tiered by verb, keyword and role."""
    acts = found.where(F.col("tag").isin(*INTERACTIVE_TAGS) | F.col("role").isin(*INTERACTIVE_ROLES))
    me = ax_id()
    hook = F.col("attrs")["data-cap"].isNotNull()
    name = F.when(hook & F.col("element_id").isNotNull(), F.col("element_id")).otherwise(F.coalesce(F.nullif(slug("name"), F.lit("")), F.lit("element")))
    text, flag = F.lit('{"value":{"type":"string"}}'), F.lit('{"checked":{"type":"boolean"}}')
    inputs = F.when(F.col("role").isin("textbox", "searchbox", "combobox", "listbox"), text).when(F.col("role").isin("checkbox", "switch"), flag).otherwise("{}")
    selector = F.when(F.col("element_id").isNotNull(), F.concat(F.lit("#"), F.regexp_replace("element_id", "([^a-zA-Z0-9_-])", r"\\$1"))).when(hook, F.concat("tag", F.lit("[data-cap]"))).otherwise(F.concat("tag", F.lit(":nth-of-type(1)")))
    return acts.select(
        F.concat(F.lit("cap:"), name, F.lit(":"), fnv1a_32(me).cast("string")).alias("id"), name.alias("name"), F.coalesce(F.nullif(F.col("name"), F.lit("")), name).alias("description"), inputs.alias("input_schema"), F.lit("{}").alias("output_schema"),
        F.lit("fallback").alias("source"), F.struct(F.lit("ax-node").alias("kind"), me.alias("ax_id"), selector.alias("selector")).alias("binding"),
        tier(F.coalesce("role", F.lit("button")), F.coalesce("name", F.lit("")), F.when(inputs == "{}", 0).otherwise(1)).alias("security"), F.lit("html:behavior").alias("provenance"), "page_id", F.col("node_index").cast("long").alias("seq"),
    )


def declared_capabilities(tools: DataFrame) -> DataFrame:
    """Capabilities that pages declare. ``tools``: page_id, name, description, input_schema, output_schema, security, ax_id, selector, seq.

    Declared schemas and tiers are kept; a tool without a tier gets one from its name.
    """
    n_inputs = F.coalesce(F.size(F.json_object_keys("input_schema")), F.lit(0))
    where = F.coalesce("ax_id", F.concat(F.lit("cap-binding:"), "name"))
    hook = F.coalesce("selector", F.concat(F.lit('[data-cap="'), "name", F.lit('"]')))
    return tools.select(
        F.concat(F.lit("cap:"), "name", F.lit(":declared")).alias("id"), "name", F.coalesce("description", "name").alias("description"), F.coalesce("input_schema", F.lit("{}")).alias("input_schema"),
        F.coalesce("output_schema", F.lit("{}")).alias("output_schema"), F.lit("webmcp").alias("source"), F.struct(F.lit("ax-node").alias("kind"), where.alias("ax_id"), hook.alias("selector")).alias("binding"),
        F.coalesce("security", tier(F.lit("button"), "name", n_inputs)).alias("security"), F.lit("declared:webmcp.json").alias("provenance"), "page_id", "seq",
    )


def declared_records(found: DataFrame) -> DataFrame:
    """Declared relations: invokers, popover targets, dialogs' openers, tabs, option choices (from_ax_id, to_ax_id, kind, trigger, cause_kind, command_value, option_value, seq)."""
    page, me = F.concat(F.lit("ax:"), "page_id", F.lit(":")), ax_id()
    none = F.lit(None).cast("string")

    def record(df: DataFrame, dst: Column, kind: str, trigger: Column | None, cause: Column | None = None, command: Column | None = None, option: Column | None = None, part: int = 0) -> DataFrame:
        pick = lambda c: none if c is None else c
        return df.select(
            "page_id", me.alias("from_ax_id"), dst.alias("to_ax_id"), F.lit(kind).alias("kind"), pick(trigger).alias("trigger"), pick(cause).alias("cause_kind"), pick(command).alias("command_value"), pick(option).alias("option_value"),
            (F.col("node_index").cast("long") * 8 + part).alias("seq"),
        )

    a = F.col("attrs")
    invokers, poppers = found.where(a["commandfor"] != ""), found.where(a["popovertarget"] != "")
    tabs, selects = found.where("role = 'tab' and size(properties.controls) > 0"), found.where("tag = 'select' or role in ('combobox', 'listbox')")
    command = F.lower(a["command"])
    opens = F.when(command == "show-modal", "open-modal").when(command.isin("close", "request-close"), "close-modal").otherwise("click")
    action = F.when(F.lower(a["popovertargetaction"]) == "hide", "hide-popover").when(F.lower(a["popovertargetaction"]) == "show", "show-popover")
    parts = [
        record(invokers, F.concat(page, a["commandfor"]), "commandfor", opens, None, command, None, 0),
        record(invokers, F.concat(page, a["commandfor"]), "state:cause", opens, F.lit("commandfor"), command, None, 1),
        record(poppers, F.concat(page, a["popovertarget"]), "popovertarget", F.lit("click"), None, action, None, 2),
        record(poppers, F.concat(page, a["popovertarget"]), "state:cause", F.lit("click"), F.lit("popovertarget"), action, None, 3),
        record(tabs, F.concat(page, F.col("properties.controls")[0]), "tab-controls", F.lit("switch-tab"), None, None, None, 4),
        record(tabs, F.concat(page, F.col("properties.controls")[0]), "state:cause", F.lit("switch-tab"), F.lit("apg-tab-activate"), None, None, 5),
        record(selects, none, "state:cause", F.lit("choose-dropdown"), F.lit("choose-dropdown"), None, a["value"], 6),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


NAV_ROLES = {"navigation": "nav", "menu": "menu", "menubar": "menubar", "tablist": "tablist"}
MEMBER_ROLES = {"nav": ("link",), "breadcrumb": ("link",), "menu": ("menuitem", "menuitemcheckbox", "menuitemradio"), "menubar": ("menuitem",), "tablist": ("tab",)}


def nav_elements(found: DataFrame) -> DataFrame:
    """Navigation structures and their members in order, numbered by kind within the page.

    Members are found by walking up: each member belongs to its nearest
    structure. The walk is by tree paths inside a page, in Arrow batches.
    """
    from pyspark.sql import Window

    crumb = F.contains(F.lower("name"), F.lit("breadcrumb"))
    kind = F.when((F.col("role") == "navigation") & crumb, "breadcrumb").otherwise(F.create_map(*[F.lit(x) for kv in NAV_ROLES.items() for x in kv])[F.col("role")])
    flat = found.select("page_id", "node_index", "parent_index", "role", "name", ax_id().alias("ax_id"), kind.alias("kind"), (F.col("states.selected") | F.coalesce(F.col("states.current").isin("page", "true"), F.lit(False))).alias("active"))

    flat = stored(flat)  # read for members and for holders; pages are parsed once

    def assign(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["node_index"])
        owner: dict[int, int | None] = {}
        kinds = {r["node_index"]: r["kind"] for r in rows}
        out = []
        for r in rows:
            i, p = r["node_index"], r["parent_index"]
            up = None if p is None else (p if kinds.get(p) else owner.get(p))
            owner[i] = up
            if up is not None and r["role"] in MEMBER_ROLES[kinds[up]]:
                out.append({"page_id": r["page_id"], "container": up, "node_index": i, "ax_id": r["ax_id"], "active": r["active"]})
        return pa.Table.from_pylist(out, schema=pa.schema([("page_id", pa.string()), ("container", pa.int32()), ("node_index", pa.int32()), ("ax_id", pa.string()), ("active", pa.bool_())]))

    members = flat.groupBy("page_id").applyInArrow(assign, "page_id string, container int, node_index int, ax_id string, active boolean")
    listed = members.groupBy("page_id", F.col("container").alias("node_index")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("node_index", "ax_id"))), lambda m: m["ax_id"]).alias("member_ax_ids"), F.min_by("ax_id", F.when(F.col("active"), F.col("node_index"))).alias("active_member_ax_id")
    )
    n = F.row_number().over(Window.partitionBy("page_id", "kind").orderBy("node_index")) - 1
    holders = flat.where("kind is not null").withColumn("n", n)
    return holders.join(listed, ["page_id", "node_index"], "left").select(
        F.concat(F.lit("nav:"), "page_id", F.lit(":"), "kind", F.lit(":"), F.col("n").cast("string")).alias("id"), "page_id", "kind", F.col("node_index").alias("in_page_dom_order"), F.col("ax_id").alias("container_ax_id"),
        F.coalesce("member_ax_ids", F.array().cast("array<string>")).alias("member_ax_ids"), "active_member_ax_id", F.nullif(F.col("name"), F.lit("")).alias("name"), F.col("node_index").cast("long").alias("seq"),
    )


def content_hash(html: str | Column) -> Column:
    return F.sha2(F.col(html) if isinstance(html, str) else html, 256)
