"""Interface states: identity, evidence, snapshots, transitions, causes, barriers.

A state's id is a hash of its canonical JSON. The JSON is built with sorted
keys in column expressions, so hashing stays in the scan; elements arrive as a
table and are gathered by state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.js import col, number_text, round_to, yes
from ..plans.catalog import Catalog, last_wins

# The fields of an element that count for identity, sorted.
ELEMENT_FIELDS = ("busy", "checked", "expanded", "open", "pressed", "selected", "visibility")
#: Phrases of authentication barriers.
KEY_PHRASES = ("security key", "insert your usb key", "touch your security key")
CODE_PHRASES = ("enter verification code", "two-factor authentication", "authenticator app")
CAPTCHA_MARKERS = ("cf-turnstile", "turnstile", "h-captcha", "g-recaptcha")

# Triggers by probe.
PROBE_TRIGGERS = {
    "focus": "focus", "hover": "hover", "click": "click", "keyEnter": "key-enter", "keySpace": "key-space", "keyEscape": "key-escape",
    "keyArrowUp": "key-arrow-up", "keyArrowDown": "key-arrow-down", "keyArrowLeft": "key-arrow-left", "keyArrowRight": "key-arrow-right",
    "keyHome": "key-home", "keyEnd": "key-end", "keyTab": "key-tab", "type": "type", "submit": "submit", "scroll": "scroll",
    "network-wait": "network-wait", "drag": "drag", "expand": "expand", "collapse": "collapse", "dialog-open": "open-modal",
    "dialog-close": "close-modal", "tab-activate": "switch-tab", "choose-dropdown": "choose-dropdown",
}
LEGACY_TRIGGERS = {"focus": "focus", "hover": "hover", "click": "click", "keyEnter": "command", "keySpace": "command", "dismiss": "command"}
BUTTON_TAGS = ("button", "a", "summary")
ARROW_PROBES = ("keyArrowUp", "keyArrowDown", "keyArrowLeft", "keyArrowRight", "keyHome", "keyEnd")


def json_string(c: str | Column) -> Column:
    """A JSON string literal, or null."""
    c = col(c)
    quoted = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.regexp_replace(quoted, r'(?s)^\{"v":(.*)\}$', "$1"))


def json_bool(c: str | Column) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit("null"))


def json_list(c: str | Column) -> Column:
    """A JSON list of strings, sorted."""
    items = F.transform(F.array_sort(F.coalesce(col(c), F.array().cast("array<string>"))), json_string)
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def json_object(pairs: list[tuple[str, Column]]) -> Column:
    """A JSON object with the keys in the given order."""
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in pairs]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def auth_json(kind: Column, role: Column, principal: Column, session: Column) -> Column:
    """The authentication context, with the fields that its kind has, sorted."""
    fields = F.array_compact(
        F.array(
            F.concat(F.lit('"kind":'), json_string(kind)),
            F.when(principal.isNotNull(), F.concat(F.lit('"principal":'), json_string(principal))),
            F.when(role.isNotNull(), F.concat(F.lit('"role":'), json_string(role))),
            F.when(session.isNotNull(), F.concat(F.lit('"session":'), json_string(session))),
        )
    )
    return F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}"))


def element_json(e: Column) -> Column:
    fields = [(f, json_string(e[f]) if f == "visibility" else json_bool(e[f])) for f in ELEMENT_FIELDS]
    return json_object(fields)


def canonical_payloads(states: DataFrame, elements: DataFrame) -> DataFrame:
    """``states`` with ``payload``, the canonical JSON that identity is derived from.

    ``states``: key, page_id, route, auth_kind, auth_role, principal, session,
    network_status, network_evidence, viewport, focused_ax_id, open_dialog_ids,
    open_popover_ids, expanded_region_ax_ids, conditional_markers.
    ``elements``: key, ax_id and the fields of an element. Positions, layers and
    focus of single elements do not count.
    """
    one = F.struct("ax_id", F.concat(json_string("ax_id"), F.lit(":"), element_json(F.struct(*ELEMENT_FIELDS))).alias("json"))
    listed = elements.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["json"]), ",").alias("_elements"))
    v = F.col("viewport")
    size = lambda k: number_text(round_to(v[k], 3))
    markers = F.transform(F.array_sort(F.map_entries(F.coalesce("conditional_markers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))), lambda m: F.concat(json_string(m["key"]), F.lit(":"), json_string(m["value"])))
    payload = json_object(
        [
            ("auth", auth_json(F.col("auth_kind"), F.col("auth_role"), F.col("principal"), F.col("session"))),
            ("conditionalMarkers", F.concat(F.lit("{"), F.array_join(markers, ","), F.lit("}"))),
            ("elements", F.concat(F.lit("{"), F.coalesce("_elements", F.lit("")), F.lit("}"))),
            ("expandedRegionAxIds", json_list("expanded_region_ax_ids")),
            ("focusedAxId", json_string("focused_ax_id")),
            ("network", json_object([("evidence", json_string("network_evidence")), ("status", json_string("network_status"))])),
            ("openDialogIds", json_list("open_dialog_ids")),
            ("openPopoverIds", json_list("open_popover_ids")),
            ("pageId", json_string("page_id")),
            ("route", json_string("route")),
            ("viewport", json_object([("dpr", size("dpr")), ("h", size("h")), ("scrollX", size("scroll_x")), ("scrollY", size("scroll_y")), ("w", size("w"))])),
        ]
    )
    return states.join(listed, "key", "left").withColumn("payload", payload).drop("_elements")


def with_ids(states: DataFrame, elements: DataFrame) -> DataFrame:
    """``states`` with ``id`` (state:sha256) and ``visual_fingerprint`` (vp: and the same hash)."""
    digest = F.sha2("payload", 256)
    out = canonical_payloads(states, elements)
    return out.withColumns({"id": F.concat(F.lit("state:"), digest), "visual_fingerprint": F.concat(F.lit("vp:"), digest)})


def merge_evidence(evidence: DataFrame) -> DataFrame:
    """(state_id, provenance, first_observed_at, evidence): each kind and source once, in order of arrival.

    A state with declared and observed evidence has the provenance of both.
    ``evidence``: state_id, kind, source_ax_id, transition_id, at, seq.
    """
    e = F.struct("seq", "kind", "source_ax_id", "transition_id", "at")
    once = evidence.groupBy("state_id", "kind", "source_ax_id").agg(F.min(e).alias("e"), F.min("at").alias("at"))
    grouped = once.groupBy("state_id").agg(
        F.bool_or(F.startswith("kind", F.lit("declared"))).alias("declared"), F.bool_or(F.startswith("kind", F.lit("observed"))).alias("observed"),
        F.min("at").alias("first_observed_at"), F.sort_array(F.collect_list("e")).alias("evidence"),
    )
    provenance = F.when(F.col("declared") & F.col("observed"), "declared+observed").when(F.col("observed"), "observed").otherwise("declared")
    return grouped.select("state_id", provenance.alias("provenance"), "first_observed_at", F.transform("evidence", lambda x: F.struct(x["kind"].alias("kind"), x["source_ax_id"].alias("source_ax_id"), x["transition_id"].alias("transition_id"), x["at"].alias("at"))).alias("evidence"))


def auth_id(kind, role, principal, session) -> Column:
    """auth:anonymous, or auth:kind:[role:]principal:session."""
    kind, role, principal, session = (col(c) for c in (kind, role, principal, session))
    return F.when(kind == "anonymous", "auth:anonymous").otherwise(F.concat_ws(":", F.lit("auth"), kind, role, F.coalesce(principal, F.lit("")), F.coalesce(session, F.lit(""))))


def auth_contexts(observed: DataFrame) -> DataFrame:
    """(id, kind, role, principal, session, first_observed_at, observation_count). ``observed``: auth_kind, auth_role, principal, session, at."""
    rows = observed.withColumn("id", auth_id("auth_kind", "auth_role", "principal", "session"))
    return rows.groupBy("id").agg(
        F.first("auth_kind").alias("kind"), F.first("auth_role").alias("role"), F.first("principal").alias("principal"), F.first("session").alias("session"),
        F.min("at").alias("first_observed_at"), F.count(F.lit(1)).alias("observation_count"),
    )


def parse_auth(spec: str | Column) -> Column:
    """struct(kind, role, principal, session) of ``anonymous``, ``authenticated:principal[:session]``,
    ``administrator:principal[:session]`` or ``custom-role:role:principal[:session]``; null if it is none."""
    parts = F.split(F.trim(col(spec)), ":")
    part = lambda k: F.nullif(F.get(parts, F.lit(k)), F.lit(""))
    kind, custom = part(0), part(0) == "custom-role"
    none = F.lit(None).cast("string")
    role = F.when(custom, part(1)).otherwise(none)
    principal = F.when(custom, part(2)).when(kind == "anonymous", none).otherwise(part(1))
    session = F.when(custom, part(3)).when(kind == "anonymous", none).otherwise(part(2))
    good = ((kind == "anonymous") & (F.size(parts) == 1)) | (kind.isin("authenticated", "administrator") & principal.isNotNull()) | (custom & role.isNotNull() & principal.isNotNull())
    return F.when(F.coalesce(good, F.lit(False)), F.struct(kind.alias("kind"), role.alias("role"), principal.alias("principal"), session.alias("session")))


def print_auth(a: Column) -> Column:
    return F.when(a["kind"] == "anonymous", "anonymous").otherwise(F.concat_ws(":", a["kind"], a["role"], a["principal"], a["session"]))


def _edge(src: Column, dst: Column, kind: str, provenance: Column | str) -> list[Column]:
    p = provenance if isinstance(provenance, Column) else F.lit(provenance)
    return [F.concat(F.lit("edge:"), src, F.lit("->"), dst, F.lit(f":{kind}")).alias("id"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), p.alias("provenance")]


def materialize(states: DataFrame, elements: DataFrame, visual: DataFrame, capabilities: DataFrame, provenance: str = "observed") -> DataFrame:
    """Edges of states: to their page, elements, visual nodes that exist, authentication context and fed capabilities.

    ``states``: id, page_id and the authentication fields. ``elements``: state_id, ax_id, visual_node_id.
    """
    i, out = F.col("id"), None
    auth = auth_id("auth_kind", "auth_role", "principal", "session")
    e = elements.withColumnRenamed("state_id", "_s")
    parts = [
        states.select(*_edge(i, F.col("page_id"), "state:on-page", provenance)),
        e.select(*_edge(F.col("_s"), F.col("ax_id"), "state:of-element", provenance)),
        e.join(visual.select(F.col("id").alias("visual_node_id")), "visual_node_id").select(*_edge(F.col("_s"), F.col("visual_node_id"), "state:visual", provenance)),
        states.select(*_edge(i, auth, "state:auth", provenance)),
        e.join(capabilities.select(F.col("binding.ax_id").alias("ax_id"), F.col("id").alias("cap")), "ax_id").select(*_edge(F.col("_s"), F.col("cap"), "state-feeds-capability", provenance)),
    ]
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out.distinct()


def successors(steps: DataFrame) -> DataFrame:
    """Successor edges of (before, after, trigger, provenance, seq) with different ends; a later trigger replaces an earlier one."""
    rows = steps.where("before <> after").select(*_edge(F.col("before"), F.col("after"), "state:successor", F.col("provenance")), F.array("trigger").alias("triggers"), "seq")
    return last_wins(rows)


def auth_transitions(steps: DataFrame) -> DataFrame:
    """Edges from anonymous to other contexts, once each. ``steps``: from_kind, from_id, to_kind, to_id, provenance."""
    rows = steps.where((F.col("from_kind") == "anonymous") & (F.col("to_kind") != "anonymous") & (F.col("from_id") != F.col("to_id")))
    return rows.select(*_edge(F.col("from_id"), F.col("to_id"), "auth:transition", F.col("provenance"))).dropDuplicates(["id"])


def resolve_causes(edges: DataFrame, evidence: DataFrame, successor_edges: DataFrame) -> DataFrame:
    """Cause edges with placeholder targets pointed at real states; those that find none are left out.

    The source element's own evidence comes first: a state whose evidence it
    caused and that a successor edge reaches, else any state it caused; the
    earliest counts.
    """
    cause = edges.where((F.col("kind") == "state:cause") & F.startswith("dst", F.lit("state:TBD:")))
    rest = edges.where(~((F.col("kind") == "state:cause") & F.startswith("dst", F.lit("state:TBD:"))))
    reached = successor_edges.where("kind = 'state:successor'").select(F.col("dst").alias("state_id")).distinct().withColumn("reached", F.lit(True))
    found = evidence.where("source_ax_id is not null").join(reached, "state_id", "left")
    best = found.groupBy(F.col("source_ax_id").alias("_source")).agg(F.min_by("state_id", F.struct((~yes("reached")).alias("late"), "seq")).alias("_state"))
    pointed = cause.join(best, F.coalesce("cause.source_ax_id", "src") == F.col("_source")).withColumn("dst", F.col("_state")).drop("_source", "_state")
    pointed = pointed.withColumn("id", F.concat(F.lit("edge:"), "src", F.lit("->"), "dst", F.lit(":"), "kind"))
    return rest.unionByName(pointed.select(rest.columns))


# snapshots


def _same_set(a: Column, b: Column) -> Column:
    none = F.array().cast("array<string>")
    a, b = F.coalesce(a, none), F.coalesce(b, none)
    return (F.size(a) == F.size(b)) & (F.size(F.array_except(a, b)) == 0)


COMPARED = ("visibility", "open", "expanded", "selected", "checked", "pressed", "busy", "z_index", "focused")


#: What the older comparison looks at: neither layers nor focus.
LEGACY_COMPARED = tuple(c for c in COMPARED if c not in ("z_index", "focused"))


def rich_snapshots(captured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshots, elements), as :func:`snapshot_changes` compares them, of captured records ``(key, snapshot string)``.

    A record is JSON: online, viewport, dialogs, popovers, expanded, markers,
    focusedAxId and elements, each with its axId. Missing fields are null;
    missing lists are empty. A record that is no JSON gives a snapshot of nulls.
    """
    flags = ("open", "expanded", "selected", "checked", "pressed", "busy", "focused")
    element = "struct<axId:string,visibility:string,zIndex:double," + ",".join(f"{f}:boolean" for f in flags) + ">"
    wire = f"online boolean, viewport string, dialogs array<string>, popovers array<string>, expanded array<string>, markers map<string,string>, focusedAxId string, elements array<{element}>"
    rows, none = captured.select("key", F.from_json("snapshot", wire).alias("s")), F.array().cast("array<string>")
    snapshots = rows.select(
        "key", "s.online", F.coalesce("s.dialogs", none).alias("open_dialog_ids"), F.coalesce("s.popovers", none).alias("open_popover_ids"), F.coalesce("s.expanded", none).alias("expanded_region_ax_ids"),
        "s.viewport", F.col("s.markers").alias("conditional_markers"), F.col("s.focusedAxId").alias("focused_ax_id"),
    )
    e = rows.select("key", F.explode("s.elements").alias("e"))
    return snapshots, e.select("key", F.col("e.axId").alias("ax_id"), "e.visibility", F.col("e.zIndex").alias("z_index"), *[F.col(f"e.{f}").alias(f) for f in flags])


def snapshot_changes(a: DataFrame, b: DataFrame, a_elements: DataFrame, b_elements: DataFrame, compared: tuple[str, ...] = COMPARED) -> DataFrame:
    """(key, differs): whether two snapshots of a key are different states.

    Snapshots: key, online, open_dialog_ids, open_popover_ids,
    expanded_region_ax_ids, viewport, conditional_markers, focused_ax_id.
    An element that appears hidden makes no difference; one that goes does.
    """
    cols = ("online", "open_dialog_ids", "open_popover_ids", "expanded_region_ax_ids", "viewport", "conditional_markers", "focused_ax_id")
    both = a.select("key", F.struct(*cols).alias("a")).join(b.select("key", F.struct(*cols).alias("b")), "key")
    x, y = F.col("a"), F.col("b")
    own = (
        ~x["online"].eqNullSafe(y["online"])
        | ~_same_set(x["open_dialog_ids"], y["open_dialog_ids"])
        | ~_same_set(x["open_popover_ids"], y["open_popover_ids"])
        | ~_same_set(x["expanded_region_ax_ids"], y["expanded_region_ax_ids"])
        | ~x["viewport"].eqNullSafe(y["viewport"])
        | ~F.array_sort(F.map_entries(x["conditional_markers"])).eqNullSafe(F.array_sort(F.map_entries(y["conditional_markers"])))
        | ~x["focused_ax_id"].eqNullSafe(y["focused_ax_id"])
    )
    left = a_elements.select("key", "ax_id", F.struct(*compared).alias("ea"))
    right = b_elements.select("key", "ax_id", F.struct(*compared).alias("eb"))
    ea, eb = F.col("ea"), F.col("eb")
    changed = F.when(eb.isNull(), True).when(ea.isNull(), ~eb["visibility"].isin("hidden", "display-none")).otherwise(~ea.eqNullSafe(eb))
    moved = left.join(right, ["key", "ax_id"], "full_outer").groupBy("key").agg(F.bool_or(changed).alias("moved"))
    return both.join(moved, "key", "left").select("key", (own | yes("moved")).alias("differs"))


def after_sets(kind: Column, command: Column, target: Column, dialogs: Column, popovers: Column) -> Column:
    """struct(open_dialog_ids, open_popover_ids) after a declared command."""
    add = lambda xs: F.when(F.array_contains(xs, target), xs).otherwise(F.array_append(xs, target))
    drop = lambda xs: F.array_remove(xs, target)
    invoker, attribute = kind == "commandfor", kind == "popovertarget"
    toggle = F.when(F.array_contains(popovers, target), drop(popovers)).otherwise(add(popovers))
    known = ("show-modal", "close", "request-close", "show-popover", "hide-popover", "toggle-popover")
    d = (
        F.when(invoker & (command == "show-modal"), add(dialogs)).when(invoker & command.isin("close", "request-close"), drop(dialogs))
        .when(kind == "dialog-open", add(dialogs)).otherwise(dialogs)
    )
    p = (
        F.when(invoker & command.isin("show-modal", "close", "hide-popover"), drop(popovers))
        .when(invoker & (command == "show-popover"), add(popovers)).when(invoker & (command == "toggle-popover"), toggle)
        .when(invoker & (command.isNull() | ~command.isin(*known)), add(popovers))
        .when(attribute & F.coalesce(command.isin("hide-popover", "close"), F.lit(False)), drop(popovers)).when(attribute, add(popovers)).otherwise(popovers)
    )
    return F.struct(d.alias("open_dialog_ids"), p.alias("open_popover_ids"))


def baseline_elements(ax: DataFrame, focused: str | None = None) -> DataFrame:
    """Element observations of a page before anything happens, from its accessibility nodes."""
    s = F.col("states")
    return ax.select(
        "page_id", F.col("id").alias("ax_id"), "visibility", *[s[f].alias(f) for f in ("open", "expanded", "selected", "checked", "pressed", "busy")],
        F.coalesce(F.col("id") == F.lit(focused), F.lit(False)).alias("focused"),
    )


def after_elements(before: DataFrame, declared: DataFrame) -> DataFrame:
    """Elements after a declared transition, by ``key``: an activated tab is selected, a former option is not.

    ``before``: page_id, ax_id and fields. ``declared``: key, page_id, kind, source_ax_id, target_ax_id.
    """
    rows = declared.join(before, "page_id")
    target = F.col("ax_id") == F.col("target_ax_id")
    selected = F.when(target & (F.col("kind") == "apg-tab-activate"), True).when(target & (F.col("kind") == "choose-dropdown"), False).otherwise(F.col("selected"))
    return rows.withColumn("selected", selected).select("key", *before.columns)


def augment(snapshot_elements: DataFrame, ax: DataFrame) -> DataFrame:
    """Snapshot elements with the states of their accessibility node where the snapshot has none."""
    s = ax.select(F.col("id").alias("ax_id"), F.col("states").alias("_s"), F.col("visibility").alias("_v"))
    joined = snapshot_elements.join(s, "ax_id", "left")
    names = ("open", "expanded", "selected", "checked", "pressed", "busy")
    return joined.withColumns({n: F.coalesce(F.col(n), F.col("_s")[n]) for n in names} | {"visibility": F.coalesce("visibility", "_v")}).select(snapshot_elements.columns)


# probes and declared relations


def trigger_of(probe: str | Column, legacy: bool = False) -> Column:
    table = LEGACY_TRIGGERS if legacy else PROBE_TRIGGERS
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[col(probe)]


def probe_applies(probe: str | Column, role: str | Column, tag: str | Column) -> Column:
    """Does a probe make sense for an element?"""
    p, role, tag = col(probe), F.coalesce(col(role), F.lit("")), F.coalesce(col(tag), F.lit(""))
    like = role.isin("button", "link", "menuitem", "tab", "switch", "checkbox", "radio") | tag.isin(*BUTTON_TAGS)
    return (
        F.when(p.isin("scroll", "network-wait", "focus", "hover", "keyEscape", "keyTab"), True)
        .when(p.isin(*ARROW_PROBES), like | role.isin("combobox", "listbox", "tab") | (tag == "select"))
        .when(p.isin("click", "submit", "expand", "collapse", "keyEnter", "keySpace", "tab-activate"), like)
        .when(p == "type", (role == "textbox") | tag.isin("input", "textarea"))
        .when(p == "drag", tag.isin("li", "div", "a"))
        .when(p == "choose-dropdown", (tag == "select") | role.isin("combobox", "listbox"))
        .when(p.isin("dialog-open", "dialog-close"), (role == "button") | (tag == "button"))
        .otherwise(False)
    )


def observed_transitions(hits: DataFrame) -> DataFrame:
    """Transition rows of probe hits (page_id, ax_id, probe, before_hash, after_hash, seq), numbered within the page."""
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("seq")) - 1
    none = F.array().cast("array<string>")
    return hits.select(
        F.concat(F.lit("trans:observed-"), "page_id", F.lit("-"), "ax_id", F.lit("-"), "probe", F.lit("-"), n.cast("string")).alias("id"), F.lit("observed").alias("kind"),
        trigger_of("probe", legacy=True).alias("trigger"), F.col("ax_id").alias("from_ax_id"), none.alias("to_ax_ids"), F.concat(F.lit("snapshot:"), "before_hash").alias("before_snapshot"),
        F.concat(F.lit("snapshot:"), "after_hash").alias("after_snapshot"), F.lit(None).cast("string").alias("apg_pattern"), none.alias("preconditions"), F.lit("dom-diff:probe").alias("provenance"), "seq",
    )


def declared_edges(records: DataFrame) -> DataFrame:
    """Edges of declared relations (from_ax_id, to_ax_id, kind, trigger, cause_kind, command_value, option_value, seq)."""
    cause = F.struct(F.col("from_ax_id").alias("source_ax_id"), F.coalesce("cause_kind", F.lit("commandfor")).alias("declared_kind"), F.col("command_value"), F.col("option_value"))
    is_cause = F.col("kind") == "state:cause"
    dst = F.when(is_cause, F.concat(F.lit("state:TBD:"), F.coalesce("cause_kind", F.lit("commandfor")), F.lit(":"), "from_ax_id")).otherwise(F.col("to_ax_id"))
    rows = records.withColumn("dst", dst).where("from_ax_id is not null and dst is not null")
    edges = rows.select(
        F.concat(F.lit("edge:"), "from_ax_id", F.lit("->"), "dst", F.lit(":"), "kind").alias("id"), F.col("from_ax_id").alias("src"), "dst", "kind", F.lit("declared").alias("provenance"),
        F.when(F.col("trigger").isNotNull(), F.array("trigger")).alias("triggers"), F.when(is_cause, cause).alias("cause"), "seq",
    )
    return last_wins(edges)


def declared_transitions(records: DataFrame) -> DataFrame:
    """Transitions of declared relations that have a trigger, numbered by kind and source."""
    n = F.row_number().over(Window.partitionBy("kind", "from_ax_id").orderBy("seq")) - 1
    rows = records.where("trigger is not null and kind <> 'state:cause'")
    none = F.array().cast("array<string>")
    return rows.select(
        F.concat(F.lit("trans:"), "kind", F.lit(":"), "from_ax_id", F.lit(":"), n.cast("string")).alias("id"), F.lit("declared").alias("kind"), "trigger", "from_ax_id",
        F.when(F.col("to_ax_id").isNotNull(), F.array("to_ax_id")).otherwise(none).alias("to_ax_ids"), F.lit(None).cast("string").alias("before_snapshot"),
        F.lit(None).cast("string").alias("after_snapshot"), F.lit(None).cast("string").alias("apg_pattern"), none.alias("preconditions"), F.lit("declared").alias("provenance"), "seq",
    )


def barriers(evidence: DataFrame) -> DataFrame:
    """(key, kind, prompt) of authentication barriers: markers, then captchas, then the first telling text.

    ``evidence``: key, conditional_markers, element_texts.
    """
    m, texts = F.col("conditional_markers"), F.coalesce("element_texts", F.array().cast("array<string>"))

    def says(t: Column, phrases) -> Column:
        out = F.lit(False)
        for p in phrases:
            out = out | F.contains(F.lower(t), F.lit(p))
        return out

    telling = F.get(F.filter(texts, lambda t: says(t, KEY_PHRASES) | says(t, CODE_PHRASES)), F.lit(0))
    captcha = F.lit(False)
    for marker in CAPTCHA_MARKERS:
        captcha = captcha | F.coalesce(F.map_contains_key(m, marker), F.lit(False))
    stated = F.nullif(m["data-auth-barrier"], F.lit(""))
    kind = F.coalesce(stated, F.when(captcha, F.lit("captcha-turnstile")), F.when(says(telling, KEY_PHRASES), F.lit("webauthn-hardware")).when(telling.isNotNull(), F.lit("sms-totp")))
    prompt = (
        F.when(stated.isNotNull(), F.coalesce(m["data-auth-prompt"], F.lit("Hardware authentication challenge active")))
        .when(captcha, "Interactive human verification (Turnstile / CAPTCHA) required").otherwise(telling)
    )
    return evidence.select("key", kind.alias("kind"), prompt.alias("prompt")).where("kind is not null")


def handshakes(found: DataFrame, timeout_ms: int = 300_000) -> DataFrame:
    """A pending handshake for each barrier (key, kind, prompt, state_id, page_id); ids derive from the state."""
    return found.select(F.concat(F.lit("hitl:"), F.sha2(F.concat_ws("|", "state_id", "kind"), 256)).alias("id"), "kind", F.lit("pending").alias("status"), "prompt", "state_id", "page_id", F.lit(timeout_ms).alias("timeout_ms"))


def resolve_handshakes(open_: DataFrame, cleared: DataFrame, trigger: str = "hitl:hardware-cleared") -> DataFrame:
    """Handshakes with those in ``cleared(id, at)`` cleared."""
    c = cleared.select("id", F.col("at").alias("cleared_at"))
    return open_.join(c, "id", "left").withColumns({"status": F.when(F.col("cleared_at").isNotNull(), "cleared").otherwise(F.col("status")), "resumption_trigger": F.when(F.col("cleared_at").isNotNull(), trigger)})


def add_states(catalog: Catalog, states: DataFrame, evidence: DataFrame) -> Catalog:
    """A catalog with more states and evidence; states of one id are one state."""
    return catalog.upsert("states", states).with_tables(state_evidence=catalog.state_evidence.unionByName(evidence, allowMissingColumns=True))
