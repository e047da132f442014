"""Governance: security tiers, decisions, posture, target scopes, rate limits, audit chain."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.js import col
from ..plans.prefix import running_sum

# Fixed values.
TIERS = ("DISCOVER", "READ", "PROPOSE", "EXECUTE", "CONFIRM")
DESTRUCTIVE = r"(?i)^(delete|remove|destroy|wipe|purge|terminate|cancel|drop|revoke|reset|clear|sign[ -]?out|log[ -]?out)\b"
SENSITIVE = r"(?i)\b(billing|payment|checkout|invoice|subscription|production|prod[ -]?env|live[ -]?env|admin|owner|transfer|wire)\b"
INPUT_ROLES = ("textbox", "searchbox", "combobox", "slider", "spinbutton")
ACTION_ROLES = ("checkbox", "switch", "button", "link", "menuitem", "tab", "option", "dialog", "alertdialog")
POSTURES = ("audit", "copilot", "autopilot", "red-team", "purple-team")
IMPACTS = ("read", "modify", "destroy", "exfiltrate")
RATE, RATE_WINDOW_MS = 1000, 60_000
# The operation that each tool or method name stands for.
ALIASES = {
    "graph_query": ("graph.query", "graph.liveRead", "graph_live_read"),
    "graph_path": ("graph.path",),
    "graph_tool": ("graph.tool",),
    "graph_explain": ("graph.explain",),
    "graph_act": ("graph.act",),
    "invoke_capability": ("graph.invoke", "graph_invoke"),
    "posture_escalate": ("posture.escalate",),
    "posture_deescalate": ("posture.deescalate",),
    "posture_revoke": ("posture.revoke",),
    "authorize": ("authorize_operation",),
    "manifest_snapshot": ("manifest.snapshot",),
    "audit_read": ("audit.read",),
    "audit_export": ("audit.export",),
    "diagnostics": ("graph_diagnostics", "substrate.info", "substrate_info", "crawl_status"),
    "visual_diff": ("graph_visualRegression", "visualRegression", "query_visual_regression", "graph.visualRegression"),
    "token_lint": ("token.lint", "lint_tokens", "graph_lintTokens", "lint_design_tokens", "graph.lintTokens"),
    "token_export": ("token.export", "export_tokens", "graph_exportTokens", "export_dtcg_tokens", "graph.exportTokens"),
    "crawl": ("crawl_start", "crawl_cancel"),
    "auth_capture": ("auth_capture_flow",),
    "desktop_act": ("desktop_kinetic_action", "desktop_replace_text", "desktop.action"),
    "desktop_read": ("desktop_list_windows", "desktop_scrape_window", "desktop_read_text", "desktop.list", "desktop.scrape"),
    "mobile_act": ("mobile_touch_action",),
    "mobile_read": ("mobile_list_devices", "mobile_scrape_device"),
    "system_doctor": ("doctor",),
    "session_capture": (),
    "visual_read": (
        "get_visual", "graph.getVisual", "get_visual_patterns", "graph.visualPatterns", "get_visual_containers", "graph.visualContainers",
        "get_spatial_neighbors", "graph.spatialNeighbors", "get_occluded_nodes", "graph.occludedNodes",
    ),
    "visual_query": ("query_viewport_diff", "graph.viewportDiff", "query_page_layout_mutations", "graph.pageLayoutMutations"),
    "chrome_read": ("chrome_targets", "chrome_read_tab", "chrome_snapshot_tab"),
    "chrome_cookies": ("chrome_get_cookies",),
    "chrome_act": ("chrome_navigate", "chrome_launch"),
}
#: Class and impact of each operation.
READS = ("graph_query", "graph_path", "graph_tool", "graph_explain", "audit_read", "diagnostics", "visual_diff", "visual_read", "visual_query", "token_lint", "desktop_read", "chrome_read", "mobile_read", "system_doctor", "manifest_snapshot")
LEAKS = ("audit_export", "token_export", "auth_capture", "session_capture", "chrome_cookies")


def tier(role: str | Column, name: str | Column, n_inputs: str | Column) -> Column:
    """Security tier: destructive verb, sensitive word, inputs, then role."""
    role, name, n = col(role), col(name), col(n_inputs)
    return (
        F.when(name.rlike(DESTRUCTIVE) | name.rlike(SENSITIVE), "CONFIRM").when((n > 0) & ~role.isin("link", "button"), "PROPOSE")
        .when(role.isin(*INPUT_ROLES), "PROPOSE").when(role.isin(*ACTION_ROLES), "EXECUTE").otherwise("READ")
    )


def tier_rank(t: str | Column) -> Column:
    return (F.array_position(F.array(*[F.lit(x) for x in TIERS]), col(t)) - 1).cast("int")


def max_tier(a: str | Column, b: str | Column) -> Column:
    return F.when(tier_rank(a) >= tier_rank(b), col(a)).otherwise(col(b))


def decide(t: str | Column, confirm: str | Column) -> Column:
    """struct(ok, require_confirm): may a capability of the tier be invoked?"""
    t, c = col(t), F.coalesce(col(confirm), F.lit(False))
    return F.struct(((t != "DISCOVER") & ((t != "CONFIRM") | c)).alias("ok"), ((t == "CONFIRM") & ~c).alias("require_confirm"))


def tools(capabilities: DataFrame, page_id: str | None = None, name: str | None = None, at_most: str | None = None, pages: DataFrame | None = None, page_url: str | None = None) -> DataFrame:
    """Capabilities of a page, by name part and highest tier."""
    df = capabilities if page_id is None else capabilities.where(F.col("page_id") == page_id)
    if page_url is not None:
        df = df.join(pages.where(F.contains("canonical_url", F.lit(page_url))).select(F.col("id").alias("_p")), F.col("page_id") == F.col("_p"), "left_semi")
    df = df if name is None else df.where(F.contains("name", F.lit(name)))
    return df if at_most is None else df.where(tier_rank("security") <= TIERS.index(at_most))


def prepare_act(capabilities: DataFrame, ax: DataFrame, confirm: bool = False) -> DataFrame:
    """Capabilities with their element and the decision about invoking them."""
    a = ax.select(F.col("id").alias("_ax"), F.col("role").alias("ax_role"), F.col("name").alias("ax_name"))
    return capabilities.join(a, F.col("binding.ax_id") == F.col("_ax"), "left").drop("_ax").withColumn("decision", decide("security", F.lit(confirm)))


def operation_of(key: str | Column) -> Column:
    """The operation that a tool or method name stands for; null denies."""
    known = {a: op for op, names in ALIASES.items() for a in (op, *names)}
    return F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[col(key)]


def impact_of(operation: str | Column) -> Column:
    op = col(operation)
    return F.when(op.isin(*READS), "read").when(op.isin(*LEAKS), "exfiltrate").when(op.isNotNull(), "modify")


def tier_impact(t: str | Column) -> Column:
    return F.when(col(t).isin("DISCOVER", "READ"), "read").when(col(t) == "CONFIRM", "destroy").otherwise("modify")


def request_target(*candidates: str | Column) -> Column:
    """What a request is about: the first field that says so (URL, page, window, device, element), else ``graph``."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in candidates], F.lit("graph"))


URL_SHAPE = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+"
BARE_HOST = r"(?i)^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+(:\d+)?(/.*)?$"


def _host(s: Column) -> Column:
    s = F.trim(s)
    full = F.lower(F.regexp_replace(F.regexp_extract(s, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1), "^[^@]*@", ""))
    full = F.when(F.startswith(F.lower(s), F.lit("https:")), F.regexp_replace(full, ":443$", "")).when(F.startswith(F.lower(s), F.lit("http:")), F.regexp_replace(full, ":80$", "")).otherwise(full)
    return F.when(s.rlike(URL_SHAPE), full).when(s.rlike(BARE_HOST), F.lower(F.substring_index(s, "/", 1)))


def _path(s: Column) -> Column:
    s = F.trim(s)
    p = F.when(s.rlike(URL_SHAPE), F.regexp_extract(s, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1)).otherwise(F.regexp_extract(s, "^[^/]*(/.*)?$", 1))
    return F.when(p == "", "/").otherwise(p)


def target_matches(target: str | Column, patterns: str | Column) -> Column:
    """Does a target fit a scope? An empty scope denies, ``*`` allows.

    A pattern with ``*`` is a glob up to a path boundary; hosts are equal and
    paths prefixes at a slash; what is no address contains the pattern.
    """
    t, ps = col(target), F.coalesce(col(patterns), F.array().cast("array<string>"))
    t_host, t_path = _host(t), _path(t)

    def fits(p: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(p, r"([.+?^${}()|\[\]\\])", r"\\$1"), r"\*", ".*")
        by_glob = F.regexp_like(t, F.concat(F.lit("^"), body, F.lit("(?:[/?#]|$)")))
        p_host, p_path = _host(p), _path(p)
        base = F.when(F.endswith(p_path, F.lit("/")), p_path).otherwise(F.concat(p_path, F.lit("/")))
        by_host = (t_host == p_host) & ((t_path == p_path) | F.startswith(t_path, base))
        return F.when(F.contains(p, F.lit("*")), by_glob).when(t_host.isNotNull() & p_host.isNotNull(), by_host).otherwise(F.contains(t, p))

    return F.array_contains(ps, "*") | F.coalesce(F.exists(ps, fits), F.lit(False))


def check_posture(requests: DataFrame, posture: str, scope: dict | None = None, now_ms: int | None = None, expires_ms: int | None = None, revoked: bool = False) -> DataFrame:
    """``requests`` (operation, substrate, target, impact) with allowed, requires_approval and reason.

    ``scope``: targets, operations, max_impact, max_substrates, max_actions.
    """
    impact = F.col("impact")
    yes_, no = F.lit(True), F.lit(False)
    if scope is not None and (revoked or (now_ms is not None and expires_ms is not None and now_ms > expires_ms)):
        return requests.withColumns({"allowed": no, "requires_approval": no, "reason": F.lit("revoked" if revoked else "expired")})
    if posture == "audit":
        return requests.withColumns({"allowed": impact == "read", "requires_approval": no, "reason": F.when(impact == "read", "audit").otherwise("audit allows reads only")})
    if posture == "copilot":
        return requests.withColumns({"allowed": yes_, "requires_approval": impact != "read", "reason": F.lit("copilot")})
    if scope is None:
        return requests.withColumns({"allowed": no, "requires_approval": no, "reason": F.lit("no authorization")})
    array = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    order = array(IMPACTS)
    operations = scope.get("operations") or []
    reason = (
        F.when(~F.array_contains(array(scope.get("max_substrates")), F.col("substrate")), "substrate out of scope")
        .when(F.lit(bool(operations) and "*" not in operations) & ~F.array_contains(array(operations), F.col("operation")), "operation out of scope")
        .when(~target_matches("target", array(scope.get("targets"))), "target out of scope")
        .when(F.array_position(order, impact) > F.array_position(order, F.lit(scope.get("max_impact", "read"))), "impact too high")
    )
    out = requests.withColumns({"allowed": reason.isNull(), "requires_approval": no, "reason": F.coalesce(reason, F.lit(posture))})
    if scope.get("max_actions"):
        if "seq" not in requests.columns:
            raise ValueError("a limit of actions needs the order of requests: seq")
        # the n-th allowed request ends the authorization; only the first n are ever ranked
        last = out.where("allowed").select("seq").orderBy("seq").limit(scope["max_actions"]).agg(F.count("seq").alias("n"), F.max("seq").alias("last")).first()
        over = F.lit(last["n"] >= scope["max_actions"]) & (F.col("seq") > F.lit(last["last"]))
        out = out.withColumns({"reason": F.when(F.col("allowed") & over, "action limit").otherwise(F.col("reason")), "allowed": F.col("allowed") & ~over})
    return out


def rate_limited(attempts: DataFrame, limit: int = RATE, window_ms: int = RATE_WINDOW_MS, key: str = "principal", counted: str | None = None) -> DataFrame:
    """``attempts`` (key, at_ms) with the attempts of the last window, itself included, and whether that is too many.

    With ``counted`` only attempts count where that column is not null.
    Attempts are counted by moment and sums run over sorted partitions, so
    neither a busy principal nor a long window falls to one task.
    """
    one = F.lit(1).cast("long") if counted is None else F.col(counted).isNotNull().cast("long")
    moments = attempts.groupBy(F.col(key).alias("w_key"), F.col("at_ms").alias("w_at")).agg(F.sum(one).alias("n"))
    # what a window holds is what there is up to its end less what there is up to its start, both read off one running sum
    ends = F.array(F.struct(F.col("w_at").alias("at"), F.lit(0).alias("asks"), F.col("n").alias("adds")), F.struct((F.col("w_at") - window_ms).alias("at"), F.lit(1).alias("asks"), F.lit(0).cast("long").alias("adds")))
    marks = moments.select("w_key", "w_at", F.explode(ends).alias("e")).select("w_key", "w_at", "e.*")
    summed = running_sum(marks, ["w_key"], ["at", "asks"], F.col("adds"), "before")
    # attempts without a moment are in one window of their own
    signed = F.when(F.col("w_at").isNull(), F.col("adds")).when(F.col("asks") == 1, -F.col("before")).otherwise(F.col("before") + F.col("adds"))
    held = summed.groupBy("w_key", "w_at").agg(F.sum(signed).alias("in_window"))
    met = attempts.join(held.hint("merge"), F.col(key).eqNullSafe(F.col("w_key")) & F.col("at_ms").eqNullSafe(F.col("w_at"))).drop("w_key", "w_at")
    return met.withColumn("limited", F.col("in_window") > limit)


def cookies_granted(requests: DataFrame, grants: DataFrame, now_ms: int) -> DataFrame:
    """``requests`` (origin, cookie) with ``granted``: a live grant of the origin whose pattern fits. ``grants``: origin, cookie_pattern, expires_at, revoked."""
    live = grants.where(~F.coalesce("revoked", F.lit(False)) & (F.col("expires_at") > now_ms)).groupBy("origin").agg(F.collect_set("cookie_pattern").alias("_patterns"))

    def fits(p: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(p, r"([.+?^${}()|\[\]\\])", r"\\$1"), r"\*", ".*")
        return F.when(F.contains(p, F.lit("*")), F.regexp_like("cookie", F.concat(F.lit("(?i)^"), body, F.lit("$")))).otherwise(p == F.col("cookie"))

    joined = requests.join(live, "origin", "left")
    return joined.withColumn("granted", F.coalesce(F.exists("_patterns", fits), F.lit(False))).drop("_patterns")


def gateway(requests: DataFrame, posture: str, scope: dict | None = None, limit: int = RATE, window_ms: int = RATE_WINDOW_MS, grants: DataFrame | None = None, now_ms: int = 0) -> DataFrame:
    """The steps of enforcement over attempts, in order: operation, rate, cookie grant, posture, approval.

    ``requests``: tool, principal, at_ms, substrate, target, seq; also
    cookie_origin and cookie where an attempt wants a sensitive cookie, and
    confirm where it was confirmed. Adds operation, impact, allowed, reason and
    ``denial``, the kind of the first step that denies (null: none).
    """
    return judge(measured(requests, limit, window_ms, grants, now_ms), posture, scope).drop("cookie_denied")


def measured(requests: DataFrame, limit: int = RATE, window_ms: int = RATE_WINDOW_MS, grants: DataFrame | None = None, now_ms: int = 0) -> DataFrame:
    """``requests`` of :func:`gateway` with the outcome of the steps that no posture changes: operation, impact, limited, cookie_denied."""
    named = requests.withColumn("operation", operation_of("tool")).withColumn("impact", impact_of("operation"))
    named = rate_limited(named, limit, window_ms, counted="operation")
    if "cookie_origin" in requests.columns:
        asked = named.withColumnRenamed("cookie_origin", "origin")
        none = "origin string, cookie_pattern string, expires_at long, revoked boolean"
        asked = cookies_granted(asked, requests.sparkSession.createDataFrame([], none) if grants is None else grants, now_ms)
        return asked.withColumn("cookie_denied", F.col("origin").isNotNull() & ~F.col("granted")).withColumnRenamed("origin", "cookie_origin").drop("granted")
    return named.withColumn("cookie_denied", F.lit(False))


def judge(attempts: DataFrame, posture: str, scope: dict | None = None) -> DataFrame:
    """``attempts`` of :func:`measured` with allowed, reason and denial under a posture; other columns stay, so several postures can be asked in turn."""
    checked = check_posture(attempts, posture, scope)
    confirmed = F.coalesce(F.col("confirm"), F.lit(False)) if "confirm" in attempts.columns else F.lit(False)
    denial = (
        F.when(F.col("operation").isNull(), "unknown_operation").when(F.col("limited"), "rate_limited").when(F.col("cookie_denied"), "cookie_grant_denied")
        .when(~F.coalesce("allowed", F.lit(False)), "posture_denied").when(F.col("requires_approval") & ~confirmed, "escalation_required")
    )
    return checked.withColumn("denial", denial).withColumns({"reason": F.coalesce(F.when(F.col("denial").isin("posture_denied", "escalation_required"), F.col("reason")), F.col("denial"), F.col("reason")), "allowed": F.col("denial").isNull()})


def audit_events(attempts: DataFrame, stream: str = "principal") -> DataFrame:
    """An audit event for each attempt of :func:`gateway`: stream_id, seq, operation, allowed, denial and ``body``, which :func:`audit_chain` chains."""
    body = F.to_json(F.struct("operation", "impact", "target", "allowed", "denial", "reason"))
    return attempts.select(F.col(stream).alias("stream_id"), "seq", "operation", "allowed", "denial", body.alias("body"))


CHAIN = pa.schema([("stream_id", pa.string()), ("sequence", pa.int64()), ("body", pa.string()), ("prev_hash", pa.string()), ("hash", pa.string())])


def chain_hash(event: dict) -> str:
    return hashlib.sha256(json.dumps(event, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def audit_chain(events: DataFrame) -> DataFrame:
    """(stream_id, sequence, body, prev_hash, hash): events of each stream chained in order. ``events``: stream_id, seq, body.

    A chain is a fold by nature, so a stream goes through one task; streams run
    in parallel. Events come sorted (of equal ``seq`` by body) and a batch at a
    time, so a task holds a batch and one hash, however long its streams are.
    """

    def fold(batches):
        stream, prev, n = None, "", 0
        for b in batches:
            rows = []
            for s, body in zip(b.column("stream_id").to_pylist(), b.column("body").to_pylist(), strict=True):
                if not n or s != stream:
                    stream, prev, n = s, "", 0
                n += 1
                row = {"stream_id": s, "sequence": n, "body": body, "prev_hash": prev}
                prev = chain_hash(row)
                rows.append(row | {"hash": prev})
            yield pa.RecordBatch.from_pylist(rows, schema=CHAIN)

    dealt = events.select("stream_id", "seq", "body").repartition("stream_id").sortWithinPartitions("stream_id", "seq", "body")
    return dealt.mapInArrow(fold, "stream_id string, sequence long, body string, prev_hash string, hash string")


def broken_links(chain: DataFrame) -> DataFrame:
    """Rows whose previous hash or sequence does not continue the chain. Rows are compared with their predecessor only."""
    w = Window.partitionBy("stream_id").orderBy("sequence")
    before = F.coalesce(F.lag("hash").over(w), F.lit(""))
    return chain.withColumns({"_p": before, "_s": F.coalesce(F.lag("sequence").over(w), F.lit(0))}).where((F.col("prev_hash") != F.col("_p")) | (F.col("sequence") != F.col("_s") + 1)).drop("_p", "_s")


def manifest_hash(manifest: dict) -> str:
    return hashlib.sha256(json.dumps(manifest, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def refresh_manifest(manifest: dict, **changes) -> dict:
    """The manifest with changes, one revision on."""
    return manifest | changes | {"revision": manifest["revision"] + 1}


def authorization_state(authorizations: DataFrame, now_ms: int) -> DataFrame:
    """``authorizations`` (approvers, signatures, expires_at, revoked) with ``valid`` and ``reason``.

    As many signatures as approvers and none empty; keys are not checked here.
    """
    signed = (F.size("approvers") == F.size("signatures")) & F.forall("signatures", lambda s: F.coalesce(F.length(s) > 0, F.lit(False)))
    reason = F.when(F.coalesce("revoked", F.lit(False)), "revoked").when(F.col("expires_at") < now_ms, "expired").when(~F.coalesce(signed, F.lit(False)), "signature").otherwise("valid")
    return authorizations.withColumn("reason", reason).withColumn("valid", F.col("reason") == "valid")


def scope_hash(scope: dict) -> str:
    return hashlib.sha256(json.dumps(scope, separators=(",", ":")).encode()).hexdigest()[:16]


def robots(texts: DataFrame) -> DataFrame:
    """(key, disallow_all, sha256) of robots.txt bodies (key, body): does the group for all agents disallow everything?"""
    lines = texts.select("key", F.posexplode(F.split("body", r"\r?\n")).alias("n", "raw"))
    clean = F.trim(F.regexp_replace("raw", "#.*$", ""))
    field = F.lower(F.regexp_extract(clean, r"^(\S+?)\s*:\s*(.*)$", 1))
    value = F.trim(F.regexp_extract(clean, r"^(\S+?)\s*:\s*(.*)$", 2))
    parsed = lines.select("key", "n", field.alias("field"), value.alias("value"))
    agent = F.last(F.when(F.col("field") == "user-agent", F.col("value")), ignorenulls=True).over(Window.partitionBy("key").orderBy("n"))
    hits = parsed.withColumn("agent", agent).groupBy("key").agg(F.bool_or((F.col("field") == "disallow") & (F.col("agent") == "*") & F.col("value").isin("/", "*")).alias("d"))
    return texts.join(hits, "key", "left").select("key", F.coalesce("d", F.lit(False)).alias("disallow_all"), F.sha2("body", 256).alias("sha256"))
