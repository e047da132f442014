"""More queries: captured documents, trees and HTML, state records, governance, layout details.

Inputs are made from whole tables with column expressions: graph documents and
platform trees as JSON text, pages as HTML.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import api
from .catalogue import BARE, VIS, found_links, nav_links, page_table, query
from .functions.urls import canonical_url
from .operators import govern, hierarchy, layout, patterns, report, state
from .plans import derive
from .plans.catalog import Catalog
from .plans.lineage import cut, shared_root
from .sources import graph_json, html, sqlite, trees

K = derive.K


def none(kind: str = "string"):
    return F.lit(None).cast(kind)


# graph documents


#: Keys of the customers or parts that one row of a document has.
PIECE = 25_000


def documents(spark, sf) -> DataFrame:
    """(doc, start, text): one graph document a nation, with its customers as elements and parts as visual nodes.

    A nation's rows grow with the tables, so its document comes in pieces, by ranges of keys.
    """
    piece = lambda k: F.coalesce(F.col(k) - F.pmod(F.col(k), F.lit(PIECE)), F.lit(0)).cast("long")
    n = derive.table(spark, sf, "nation")
    c = derive.table(spark, sf, "customer").withColumn("c_start", piece("c_custkey"))
    ax = c.groupBy("c_nationkey", "c_start").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("c_custkey").alias("order"), F.concat(F.lit("ax:"), "c_custkey").alias("id"), F.concat(F.lit("page:"), "c_nationkey").alias("pageId"), F.lit("button").alias("role"), F.col("c_name").alias("name"),
                    F.struct((F.col("c_custkey") % 2 == 0).alias("expanded"), (F.col("c_custkey") % 3 == 0).alias("current")).alias("states"),
                )
            )
        ).alias("axNodes")
    )
    p = derive.table(spark, sf, "part").withColumn("k", F.col("p_partkey") % 25).withColumn("v_start", piece("p_partkey"))
    visual = p.groupBy("k", "v_start").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("p_partkey").alias("order"), F.concat(F.lit("vis:"), "p_partkey").alias("id"), F.concat(F.lit("el:"), "p_partkey").alias("axId"), F.struct(F.col("p_size").alias("w")).alias("rect"),
                    F.to_json(F.create_map(F.lit("background-color"), F.col("p_brand"), F.lit("flex-wrap"), F.lit("wrap"), F.lit("--own-x"), F.lit("1"))).alias("look"),
                    F.struct(F.concat(F.lit("el:"), F.col("p_partkey") - F.col("p_partkey") % 100 + F.col("k")).alias("parent"), F.array(F.concat(F.lit("vis:"), "p_partkey"), F.lit("el:gone")).alias("children")).alias("tethers"),
                    F.struct(F.when(F.col("p_partkey") % 2 == 0, "auto").otherwise(F.col("p_size").cast("string")).alias("zIndex")).alias("stackingContext"),
                )
            )
        ).alias("visualNodes")
    )
    # lists of a nation's rows are larger than they are estimated: none is collected in the driver to be broadcast
    ax, visual = ax.hint("merge"), visual.hint("merge")
    starts = spark.range(1).select(F.col("id").alias("start")).union(c.select("c_start")).union(p.select("v_start")).distinct()
    pieces = n.crossJoin(starts)
    whole = pieces.join(ax, (F.col("n_nationkey") == F.col("c_nationkey")) & (F.col("start") == F.col("c_start")), "left")
    whole = whole.join(visual, (F.col("n_nationkey") == F.col("k")) & (F.col("start") == F.col("v_start")), "left")
    first = F.col("start") == 0
    whole = whole.where(first | F.col("axNodes").isNotNull() | F.col("visualNodes").isNotNull())
    of_all = lambda value, name: F.when(first, value).alias(name)
    doc = F.to_json(
        F.struct(
            F.lit("1.0.0").alias("version"), of_all(F.struct(F.concat(F.lit("http://"), "n_name").alias("rootUrl"), F.lit("2024").alias("startedAt")), "crawl"),
            of_all(F.array(F.struct(F.concat(F.lit("page:"), "n_nationkey").alias("id"), F.col("n_name").alias("title"), F.lit("complete").alias("loadStatus"))), "pages"),
            "axNodes", "visualNodes",
            of_all(F.array(F.struct(F.concat(F.lit("page:"), "n_regionkey").alias("from"), F.concat(F.lit("page:"), "n_nationkey").alias("to"), F.lit("nav:child-of").alias("kind"), F.concat(F.lit("edge:"), "n_nationkey").alias("id"))), "edges"),
            of_all(F.struct(F.struct(F.struct(F.lit("color").alias("$type"), F.concat(F.lit("#00000"), F.col("n_nationkey") % 10).alias("$value")).alias("base"), F.struct(F.col("n_nationkey").alias("$value")).alias("untyped")).alias("c")), "designTokens"),
            of_all(F.struct(F.array(F.struct(F.concat(F.lit("u"), "n_nationkey").alias("url"), F.lit("broken").alias("error"))).alias("pageErrors")), "diagnostics"),
            of_all(F.array(F.struct(F.concat(F.lit("auth:"), "n_nationkey").alias("id"), F.struct(F.lit("custom-role").alias("kind"), F.col("n_name").alias("role")).alias("context"), F.lit(3).alias("observationCount"))), "authContexts"),
        )
    )
    # struct fields cannot hold a parsed map beside text, so the look is put in as an object
    text = F.regexp_replace(F.regexp_replace(doc, r'"look":"(\{.*?\})"', r'"computedStyle":$1'), r'\\"', '"')
    return cut(whole.select(F.col("n_nationkey").cast("long").alias("doc"), "start", text.alias("text")))  # each table is parsed from it


@query(
    "s_document_elements",
    "SELECT concat('ax:', c_custkey) AS id, concat('page:', c_nationkey) AS page_id, c_name AS name, c_custkey % 2 = 0 AS expanded, CASE WHEN c_custkey % 3 = 0 THEN 'true' ELSE 'false' END AS here FROM customer",
)
def _(spark, sf):
    """Elements of many graph documents."""
    return graph_json.from_documents(documents(spark, sf)).ax.select("id", "page_id", "name", "states.expanded", F.col("states.current").alias("here"))


@query(
    "s_document_visual",
    f"SELECT concat('vis:', {K}) AS id, CAST(p_size AS DOUBLE) AS w, p_brand AS back, 'wrap' AS wrap, '1' AS own, CASE WHEN {K} % 2 = 1 THEN p_size END AS z_index, "
    f"CASE WHEN {K} - {K} % 100 + {K} % 25 IN (SELECT {K} FROM part) THEN 'vis:' ELSE 'el:' END || ({K} - {K} % 100 + {K} % 25) AS parent, concat('vis:', {K}, '|el:gone') AS children FROM part",
)
def _(spark, sf):
    """Visual nodes of many graph documents: style names, layers, and tethers that name visual nodes."""
    v = graph_json.from_documents(documents(spark, sf)).visual
    return v.select("id", "rect.w", F.col("style")["backgroundColor"].alias("back"), F.col("style")["flex-wrap"].alias("wrap"), F.col("style")["--own-x"].alias("own"), "z_index", "tethers.parent", F.array_join("tethers.children", "|").alias("children"))


@query(
    "s_document_rest",
    "SELECT 'page' AS kind, concat('page:', n_nationkey) AS id, n_name AS what FROM nation UNION ALL SELECT 'edge', concat('edge:', n_nationkey), concat('page:', n_regionkey, '>page:', n_nationkey) FROM nation "
    "UNION ALL SELECT 'auth', concat('auth:', n_nationkey), concat('custom-role ', n_name, ' 3') FROM nation UNION ALL SELECT 'meta', concat('http://', n_name), '2024' FROM nation "
    "UNION ALL SELECT 'token', 'c.base', concat('#00000', n_nationkey % 10) FROM nation UNION ALL SELECT 'problem', concat('u', n_nationkey), 'broken' FROM nation",
)
def _(spark, sf):
    """Pages, edges, contexts, meta rows, tokens (leaves with a value and a type) and diagnostics of many graph documents."""
    c = graph_json.from_documents(documents(spark, sf))
    parts = [
        ("page", c.pages, "id", F.col("title")), ("edge", c.edges, "id", F.concat("src", F.lit(">"), "dst")), ("auth", c.auth, "id", F.concat_ws(" ", "kind", "role", "observation_count")),
        ("meta", c.meta, "root_url", F.col("started_at")), ("token", c.tokens, "path", F.col("value")), ("problem", c.diagnostics, "url", F.col("message")),
    ]
    out = None
    for kind, df, key, what in parts:
        one = df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), what.alias("what"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "m_provenance",
    "SELECT concat('http://', n_name) AS root_url, CASE WHEN n_nationkey % 3 = 0 THEN '2025' ELSE '2024' END AS started_at, CASE WHEN n_nationkey % 3 = 0 THEN 'b2' END AS build_version "
    "FROM nation WHERE n_nationkey % 5 <> 1 UNION ALL SELECT concat('new://', r_name), '2025', 'b2' FROM region",
)
def _(spark, sf):
    """Where graphs come from, after it was set for some roots, known and new, twice for some, and taken away from others."""
    c = graph_json.from_documents(documents(spark, sf))
    nation, region = derive.table(spark, sf, "nation"), derive.table(spark, sf, "region")
    known = nation.where("n_nationkey % 3 = 0").select(F.concat(F.lit("http://"), "n_name").alias("root_url"))
    roots = known.unionByName(region.select(F.concat(F.lit("new://"), "r_name").alias("root_url")))
    one = lambda year, build: roots.withColumns({"started_at": F.lit(year), "build_version": F.lit(build)})
    gone = nation.where("n_nationkey % 5 = 1").select(F.concat(F.lit("http://"), "n_name").alias("root_url"))
    c = c.with_provenance(one("2023", "b1").unionByName(one("2025", "b2"))).without_provenance(gone)
    return c.provenance().select("root_url", "started_at", "build_version")


def working_folder(spark, label: str) -> str:
    """A new folder beside the checkpoints."""
    return f"{shared_root(spark)}/surfacegraph-{label}-{uuid.uuid4().hex}"


@query("k_catalog_round_trip", "SELECT concat('ax:', c_custkey) AS id, c_name AS name FROM customer UNION ALL SELECT concat('edge:', n_nationkey), 'nav:child-of' FROM nation")
def _(spark, sf):
    """Elements and edges of a catalog that was saved, replaced by a second save, and loaded."""
    c, path = graph_json.from_documents(documents(spark, sf)), working_folder(spark, "catalog")
    graph_json.save(c.with_tables(ax=c.ax.limit(0)), path)
    graph_json.save(c, path, overwrite=True)
    back = graph_json.load(spark, path)
    return back.ax.select("id", "name").unionByName(back.edges.select("id", F.col("kind").alias("name")))


@query("k_document_round_trip", "SELECT concat('page:', n_nationkey) AS id, n_name AS title FROM nation")
def _(spark, sf):
    """Pages of a catalog that was written as one document and read again."""
    c = graph_json.from_documents(documents(spark, sf))
    small = Catalog(spark, {"pages": c.pages, "tokens": c.tokens.dropDuplicates(["path"]), "edges": c.edges})
    return graph_json.from_document(spark, graph_json.to_document(small)).pages.select("id", "title")


@query(
    "k_sqlite_round_trip",
    "SELECT 'element' AS kind, concat('ax:', c_custkey) AS id, c_name AS what FROM customer UNION ALL SELECT 'element', 'ax:stays', 'old' UNION ALL SELECT 'edge', concat('edge:', n_nationkey), concat('page:', n_regionkey) FROM nation "
    f"UNION ALL SELECT 'visual', concat('vis:', {K}), p_brand FROM part UNION ALL SELECT 'auth', concat('auth:', n_nationkey), n_name FROM nation UNION ALL SELECT 'token', 'c.base', concat('#00000', (SELECT max(n_nationkey) FROM nation) % 10)",
)
def _(spark, sf):
    """A catalog saved into a SQLite file over an older one, and scanned: rows of other ids stay, edges and tokens are replaced."""
    c, path = graph_json.from_documents(documents(spark, sf)), working_folder(spark, "sqlite") + ".db"
    old = spark.createDataFrame([("ax:stays", "old", 0), ("ax:1", "gone", 1)], "id string, name string, seq long")
    edge = spark.createDataFrame([("edge:gone", "a", "b", "k", 0)], "id string, src string, dst string, kind string, seq long")
    sqlite.save(Catalog(spark, {"ax": old, "edges": edge}), path)
    sqlite.save(c, path)
    back = sqlite.load(spark, path)
    token = F.concat(F.col("value"), F.lit(""))
    parts = [("element", back.ax, "id", F.col("name")), ("edge", back.edges, "id", F.col("src")), ("visual", back.visual, "id", F.col("style")["backgroundColor"]), ("auth", back.auth, "id", F.col("role")), ("token", back.tokens, "path", token)]
    out = None
    for kind, df, key, what in parts:
        one = df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), what.alias("what"))
        out = one if out is None else out.unionByName(one)
    return out


@query("k_logs", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    """A log appended to in two steps and read as JSON lines."""
    path, e = working_folder(spark, "log"), derive.table(spark, sf, "events").select(F.col("event_type").alias("kind"), "event_id")
    graph_json.append_log(e.where("event_id % 2 = 0"), path)
    graph_json.append_log(e.where("event_id % 2 = 1"), path)
    return spark.read.schema("kind string, event_id long").json(path).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("k_trace", "SELECT event_id AS task, value AS duration_ms FROM events")
def _(spark, sf):
    path = working_folder(spark, "trace")
    graph_json.write_trace(derive.table(spark, sf, "events").select(F.col("event_id").alias("task"), F.col("value").alias("duration_ms")), path)
    return spark.read.schema("task long, duration_ms double").json(path)


@query("k_viewer", "SELECT '/summary.json' AS path, (SELECT count(*) FROM nation) AS pages UNION ALL SELECT '/graph.json', (SELECT count(*) FROM nation)")
def _(spark, sf):
    """How many pages the viewer's bodies name."""
    c = graph_json.from_documents(documents(spark, sf))
    small = Catalog(spark, {"pages": c.pages})
    rows = []
    for path in ("/summary.json", "/graph.json"):
        body = api.viewer_body(small, path)
        rows.append((path, len(body["pages"])))
    return spark.createDataFrame(rows, "path string, pages long")


@query("a_frontier_hash", "SELECT sha256(string_agg(url, chr(10) ORDER BY url)) AS frontier_hash FROM pages")
def _(spark, sf):
    return graph_json.frontier_hash(derive.table(spark, sf, "pages"))


@query("s_token_trees", "SELECT n_nationkey AS key, TRUE AS typed, 'a.b|a.c.d' AS paths FROM nation UNION ALL SELECT n_nationkey, FALSE, 'a.b|a.c.d|a.e' FROM nation")
def _(spark, sf):
    """Leaves of token trees: with a value and a type, and with a value only."""
    tree = F.concat(F.lit('{"$description": "x", "a": {"$type": "g", "b": {"$value": "'), "n_name", F.lit('", "$type": "color"}, "c": {"d": {"$value": 1, "$type": "number"}}, "e": {"$value": 2}}}'))
    n = derive.table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), tree.alias("tree"))

    def run(typed: bool):
        import pyarrow as pa

        def leaves(batches):
            for b in batches:
                paths = ["|".join(r[0] for r in graph_json.token_rows(json.loads(t), typed)) for t in b.column("tree").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([typed] * len(paths)), pa.array(paths)], names=["key", "typed", "paths"])

        return n.mapInArrow(leaves, "key int, typed boolean, paths string")

    return run(True).unionByName(run(False))


@query("g_binding", "SELECT sha256(string_agg(n_name, ',' ORDER BY n_nationkey)) AS graph_hash, TRUE AS same, FALSE AS other FROM nation")
def _(spark, sf):
    """A catalog's hash, and whether it binds to that hash and to another."""
    names = derive.table(spark, sf, "nation").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), ","), 256).alias("graph_hash"))
    got, c, ok = names.first()["graph_hash"], Catalog(spark), {}
    for label, expected in (("same", got), ("other", "0" * 64)):
        try:
            graph_json.bind(c, got, expected)
            ok[label] = True
        except graph_json.SubstrateError:
            ok[label] = False
    return names.select("graph_hash", F.lit(ok["same"]).alias("same"), F.lit(ok["other"]).alias("other"))


@query("s_refusals", "SELECT * FROM (VALUES ('old version', 'SUBSTRATE_INVALID'), ('no json', 'SUBSTRATE_INVALID'), ('missing', 'SUBSTRATE_MISSING'), ('exists', 'SUBSTRATE_EXISTS'), ('incomplete', 'SUBSTRATE_INCOMPLETE')) t(what, code)")
def _(spark, sf):
    """What loading and saving refuse, and with which code."""
    path = working_folder(spark, "refused")
    graph_json.save(Catalog(spark, {"meta": spark.createDataFrame([("1.0.0", False)], "version string, complete boolean").select("version", none().alias("root_url"), none().alias("started_at"), "complete", none().alias("frontier_hash"), none().alias("build_version"))}), path)
    attempts = {
        "old version": lambda: graph_json.from_document(spark, {"version": "0.9"}), "no json": lambda: graph_json.from_documents(spark.createDataFrame([(0, "{")], "doc long, text string")),
        "missing": lambda: graph_json.load(spark, path + "-none"), "exists": lambda: graph_json.save(Catalog(spark), path), "incomplete": lambda: graph_json.load(spark, path),
    }
    rows = []
    for what, f in attempts.items():
        try:
            f()
            rows.append((what, None))
        except graph_json.SubstrateError as e:
            rows.append((what, e.code))
    return spark.createDataFrame(rows, "what string, code string")


# trees of other platforms

WINDOWS_TYPE = derive.cases(K, 6, {0: "'ControlType.Button'", 1: "'Edit'", 2: "'UIA_TabItemControlTypeId'", 3: "'Hyperlink'", 4: "'CheckBox'"}, "'Pane'")
MACOS_ROLE = derive.cases(K, 6, {0: "'AXButton'", 1: "'AXTextField'", 2: "'AXCheckBox'", 3: "'AXSheet'", 4: "'AXStaticText'"}, "'AXGroup'")
ANDROID_CLASS = derive.cases(K, 6, {0: "'android.widget.RadioButton'", 1: "'android.widget.EditText'", 2: "'android.widget.TextView'", 3: "'android.widget.ImageView'", 4: "'androidx.recyclerview.widget.RecyclerView'"}, "'android.view.View'")
IOS_TYPE = derive.cases(K, 6, {0: "'XCUIElementTypeButton'", 1: "'XCUIElementTypeTextField'", 2: "'XCUIElementTypeSwitch'", 3: "'XCUIElementTypeCell'", 4: "'XCUIElementTypeAlert'"}, "'XCUIElementTypeOther'")


def dumps(spark, sf, root: str, child: str) -> DataFrame:
    """(page_id, url, tree): a tree with one child for each part."""
    p = derive.spread(derive.table(spark, sf, "part"), K)
    return p.select(F.concat(F.lit("w"), K).alias("page_id"), F.lit("app").alias("url"), F.concat(F.lit(f'{{{root}, "children": [{{'), F.expr(child), F.lit("}]}")).alias("tree"))


def leaf(found: DataFrame) -> DataFrame:
    return found.where("parent_index = 0").select("page_id", "role", "name", "tag", F.col("states.disabled").alias("disabled"), "focusable")


ENABLED = f"CASE WHEN {K} % 2 = 0 THEN 'true' ELSE 'false' END"


@query("s_windows", f"SELECT concat('w', {K}) AS page_id, CASE {K} % 6 WHEN 0 THEN 'button' WHEN 1 THEN 'textbox' WHEN 2 THEN 'tab' WHEN 3 THEN 'link' WHEN 4 THEN 'checkbox' ELSE 'generic' END AS role, p_name AS name, lower({WINDOWS_TYPE}) AS tag, {K} % 2 = 1 AS disabled, TRUE AS focusable FROM part")
def _(spark, sf):
    return leaf(trees.trees(dumps(spark, sf, '"controlType": "Window", "name": "top"', f"concat('\"ControlType\": \"', {WINDOWS_TYPE}, '\", \"Name\": \"', p_name, '\", \"isEnabled\": ', {ENABLED})"), "windows"))


@query("s_macos", f"SELECT concat('w', {K}) AS page_id, CASE {K} % 6 WHEN 0 THEN 'button' WHEN 1 THEN 'textbox' WHEN 2 THEN 'checkbox' WHEN 3 THEN 'dialog' WHEN 4 THEN 'text' ELSE 'generic' END AS role, p_name AS name, lower({MACOS_ROLE}) AS tag, {K} % 2 = 1 AS disabled, TRUE AS focusable FROM part")
def _(spark, sf):
    return leaf(trees.trees(dumps(spark, sf, '"role": "AXWindow"', f"concat('\"role\": \"', {MACOS_ROLE}, '\", \"title\": \"', p_name, '\", \"enabled\": ', {ENABLED})"), "macos"))


@query("s_android", f"SELECT concat('w', {K}) AS page_id, CASE {K} % 6 WHEN 0 THEN 'button' WHEN 1 THEN 'textbox' WHEN 2 THEN CASE WHEN {K} % 4 = 0 THEN 'button' ELSE 'text' END WHEN 3 THEN CASE WHEN {K} % 4 = 0 THEN 'button' ELSE 'img' END WHEN 4 THEN 'list' ELSE CASE WHEN {K} % 4 = 0 THEN 'button' ELSE 'generic' END END AS role, p_name AS name, lower(list_last(string_split({ANDROID_CLASS}, '.'))) AS tag, {K} % 2 = 1 AS disabled, {K} % 3 = 0 AS focusable FROM part")
def _(spark, sf):
    child = f"concat('\"className\": \"', {ANDROID_CLASS}, '\", \"text\": \"', p_name, '\", \"enabled\": ', {ENABLED}, ', \"clickable\": ', CASE WHEN {K} % 4 = 0 THEN 'true' ELSE 'false' END, ', \"focused\": ', CASE WHEN {K} % 3 = 0 THEN 'true' ELSE 'false' END)"
    return leaf(trees.trees(dumps(spark, sf, '"className": "android.widget.FrameLayout"', child), "android"))


@query("s_ios", f"SELECT concat('w', {K}) AS page_id, CASE {K} % 6 WHEN 0 THEN 'button' WHEN 1 THEN 'textbox' WHEN 2 THEN 'switch' WHEN 3 THEN 'listitem' WHEN 4 THEN 'dialog' ELSE 'generic' END AS role, p_name AS name, lower(replace({IOS_TYPE}, 'XCUIElementType', '')) AS tag, {K} % 2 = 1 AS disabled, TRUE AS focusable FROM part")
def _(spark, sf):
    return leaf(trees.trees(dumps(spark, sf, '"type": "XCUIElementTypeWindow"', f"concat('\"type\": \"', {IOS_TYPE}, '\", \"label\": \"', p_name, '\", \"enabled\": ', {ENABLED})"), "ios"))


@query("s_android_xml", f"SELECT concat('w', {K}) AS page_id, CASE WHEN {K} % 2 = 0 THEN 'button' ELSE 'text' END AS role, p_name AS name, CAST({K} % 300 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS w FROM part")
def _(spark, sf):
    """UI dumps as XML: roles, names and boxes of their visual nodes."""
    node = f"concat('<hierarchy><node class=\"android.widget.FrameLayout\" bounds=\"[0,0][400,800]\"><node class=\"android.widget.TextView\" text=\"', p_name, '\" clickable=\"', {ENABLED}, '\" bounds=\"[', {K} % 300, ',5][', {K} % 300 + p_size, ',25]\"/></node></hierarchy>')"
    p = derive.spread(derive.table(spark, sf, "part"), K).select(F.concat(F.lit("w"), K).alias("page_id"), F.lit("app").alias("url"), F.expr(node).alias("tree"))
    return trees.visual_nodes(trees.trees(p, "android-xml")).where("name <> ''").select("page_id", "role", "name", "rect.x", "rect.w")


@query("s_cdp", f"SELECT concat('w', {K} % 20) AS page_id, {K} AS node_id, CASE {K} % 5 WHEN 0 THEN 'document' WHEN 1 THEN 'text' WHEN 2 THEN 'img' WHEN 3 THEN 'generic' ELSE 'button' END AS role FROM part WHERE {K} % 7 > 0")
def _(spark, sf):
    """Flat protocol trees without ignored nodes, with known roles."""
    role = F.expr(derive.cases(K, 5, {0: "'RootWebArea'", 1: "'StaticText'", 2: "'image'", 3: "''"}, "'Button'"))
    p = derive.table(spark, sf, "part").select(F.concat(F.lit("w"), F.col(K) % 20).alias("page_id"), F.col(K).alias("node_id"), none("bigint").alias("parent_id"), role.alias("role"), F.col("p_name").alias("name"), (F.col(K) % 7 == 0).alias("ignored"), F.col(K).alias("seq"))
    return trees.cdp(p).select("page_id", "node_id", "role")


@query("v_tree_patterns", f"SELECT concat('w', {K}) AS page_id, 'dialog-overlay' AS pattern FROM part WHERE {K} % 6 = 3")
def _(spark, sf):
    """Dialogs found among the visual nodes of desktop trees."""
    child = f"concat('\"role\": \"', {MACOS_ROLE}, '\", \"title\": \"', p_name, '\", \"frame\": {{\"x\": 500, \"y\": 300, \"w\": 400, \"h\": 200}}')".replace("{{", "{").replace("}}", "}")
    found = trees.visual_nodes(trees.trees(dumps(spark, sf, '"role": "AXGroup"', child), "macos"))
    return patterns.patterns(found).select("page_id", F.col("primary_pattern").alias("pattern")).where("pattern = 'dialog-overlay'")


@query("s_raw_visual", f"SELECT concat('v', {K}) AS id, concat('ax:w:', {K}) AS ax_id, CAST(p_size AS DOUBLE) AS w, 'grid' AS container_type, {K} % 2 = 0 AS is_stacking, CASE WHEN {K} % 10 > 0 THEN concat('v', {K} - {K} % 10) END AS parent FROM part")
def _(spark, sf):
    """Visual nodes of captured elements: boxes, containers, stacking and parents."""
    p = derive.table(spark, sf, "part")
    ax = lambda k: F.concat(F.lit("ax:w:"), k.cast("string"))
    k = F.col(K)
    style = F.create_map(F.lit("display"), F.lit("grid"), F.lit("position"), F.when(k % 2 == 0, "fixed").otherwise("static"), F.lit("padding-left"), F.lit("2px"))
    raw = p.select(
        F.lit("w").alias("page_id"), F.concat(F.lit("v"), k).alias("id"), ax(k).alias("ax_id"), F.when(k % 10 > 0, ax(k - k % 10)).alias("parent_ax_id"), F.lit("DIV").alias("tag"), none().alias("element_id"), none().alias("class_name"),
        F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("p_size").cast("double").alias("w"), F.lit(9.0).alias("h")).alias("rect"), style.alias("style"), F.lit(0).alias("child_count"),
        F.lit(0.0).alias("scroll_w"), F.lit(0.0).alias("scroll_h"), F.lit(0.0).alias("client_w"), F.lit(0.0).alias("client_h"), k.alias("seq"),
    )
    v = layout.visual_nodes(raw)
    return v.select("id", "ax_id", "rect.w", "container_type", F.col("is_stacking_context").alias("is_stacking"), F.col("tethers.parent").alias("parent"))


# layout details


@query("v_scroll_context", f"{VIS}, m AS (SELECT *, CASE WHEN seq % 4 = 0 THEN 'hidden' WHEN seq % 4 = 1 THEN 'auto' ELSE 'visible' END AS o FROM v) SELECT id, o = 'auto' OR w > 41 OR h > 41 AS is_scroll, w > 41 AS can_x, o <> 'visible' AS is_clipped FROM m")
def _(spark, sf):
    v, k = derive.visual(spark, sf), F.col("seq")
    style = F.create_map(F.lit("overflow"), F.when(k % 4 == 0, "hidden").when(k % 4 == 1, "auto").otherwise("visible"))
    s = layout.scroll_context(style, F.col("rect.w"), F.col("rect.h"), F.lit(40.0), F.lit(40.0))
    return v.select("id", s.alias("s")).select("id", F.col("s.is_scroll_container").alias("is_scroll"), F.col("s.can_scroll_x").alias("can_x"), "s.is_clipped")


@query("v_render_bounds", f"{VIS} SELECT id, w AS layout_w, w * 2 AS seen_w, seq % 3 = 0 AS has_transform, CASE WHEN seq % 3 = 0 THEN 'scale(2)' END AS transform FROM v")
def _(spark, sf):
    v, r = derive.visual(spark, sf), F.col("rect")
    seen = F.struct(r["x"].alias("x"), r["y"].alias("y"), (r["w"] * 2).alias("w"), r["h"].alias("h"))
    style = F.create_map(F.lit("transform"), F.when(F.col("seq") % 3 == 0, "scale(2)").otherwise("none"))
    b = v.select("id", layout.render_bounds(seen, r, style).alias("b"))
    return b.select("id", F.col("b.layout.w").alias("layout_w"), F.col("b.transformed.w").alias("seen_w"), "b.has_transform", "b.transform")


@query("v_interpret", f"{VIS} SELECT id, CASE WHEN s_display = 'grid' THEN CASE seq % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END END AS columns, CASE WHEN s_display = 'flex' THEN CASE WHEN seq % 2 = 0 THEN 'vertical' ELSE 'horizontal' END END AS main_axis, CASE WHEN s_display = 'flex' THEN s_flex_wrap = 'wrap' END AS wraps, s_cursor = 'pointer' AS is_interactive FROM v")
def _(spark, sf):
    """Grids, flex rows and prominence of nodes; a repeated track counts as the words it is written in."""
    v, k = derive.visual(spark, sf), F.col("seq")
    tracks = F.when(k % 3 == 0, "repeat(3, 1fr)").when(k % 3 == 1, "1fr 2fr 10px").otherwise("none")
    more = F.create_map(F.lit("grid-template-columns"), tracks, F.lit("flex-direction"), F.when(k % 2 == 0, "column").otherwise("row"))
    n = layout.interpret(v.withColumn("style", F.map_concat("style", more)))
    return n.select("id", F.size("grid.columns").alias("columns"), "flex.main_axis", F.col("flex.wrap").alias("wraps"), "prominence.is_interactive")


# HTML

def invokers(spark, sf) -> DataFrame:
    """Pages with an invoker, a popover button, a tab list, a menu and a select each; names are those of nations."""
    n = derive.table(spark, sf, "nation")
    body = (
        "concat('<body><nav aria-label=\"Breadcrumb ', n_name, '\"><a href=\"/a\">A</a><a href=\"/b\" aria-current=\"page\">B</a></nav>', "
        "'<label for=\"q\">Search ', n_name, '</label><input id=\"q\" type=\"search\" placeholder=\"p\"><input type=\"text\" placeholder=\"City\"><input type=\"text\" title=\"Zip\">', "
        "'<img alt=\"Logo\" src=\"x\"><span id=\"t\">Save</span><button id=\"b', n_nationkey, '\" aria-labelledby=\"t\" commandfor=\"d\" command=\"show-modal\" aria-expanded=\"', CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'false' END, '\">x</button>', "
        "'<dialog id=\"d\">hi</dialog><button id=\"p\" popovertarget=\"o\" disabled>Delete it</button><div id=\"o\" popover style=\"display: none\">o</div>', "
        "'<div role=\"tablist\" id=\"l\"><div role=\"tab\" id=\"t1\" aria-controls=\"pan\" aria-selected=\"true\" tabindex=\"0\">One</div><div role=\"tab\" id=\"t2\" aria-controls=\"pan\">Two</div></div><div role=\"tabpanel\" id=\"pan\" aria-labelledby=\"t1\">c</div>', "
        "'<ul role=\"menu\" id=\"m\"><li role=\"menuitem\">Cut</li><li role=\"menuitem\">Paste</li></ul><select id=\"s\"><option value=\"1\">1</option></select><div hidden aria-owns=\"q\" id=\"own\"></div></body>')"
    )
    return n.select(F.concat(F.lit("page:"), "n_nationkey").alias("page_id"), F.concat(F.lit("http://x/"), "n_nationkey").alias("url"), F.expr(body).alias("html"))


NAMED = (
    ("'b' || n_nationkey", "'button'", "'Save'", "'aria-labelledby'", "TRUE", "'visible'", "n_nationkey % 2 = 0", "CAST(NULL AS BOOLEAN)"),
    ("'p'", "'button'", "'Delete it'", "'content'", "FALSE", "'visible'", "CAST(NULL AS BOOLEAN)", "TRUE"),
    ("'q'", "'searchbox'", "'Search ' || n_name", "'label'", "TRUE", "'visible'", "CAST(NULL AS BOOLEAN)", "CAST(NULL AS BOOLEAN)"),
    ("'t1'", "'tab'", "'One'", "'content'", "TRUE", "'visible'", "CAST(NULL AS BOOLEAN)", "CAST(NULL AS BOOLEAN)"),
    ("'o'", "'presentation'", "'o'", "'content'", "FALSE", "'display-none'", "CAST(NULL AS BOOLEAN)", "CAST(NULL AS BOOLEAN)"),
    ("'own'", "'presentation'", "''", "'content'", "FALSE", "'hidden'", "CAST(NULL AS BOOLEAN)", "CAST(NULL AS BOOLEAN)"),
)
PAGE = "concat('page:', n_nationkey)"


@query("n_names_states", " UNION ALL ".join(f"SELECT concat('ax:', {PAGE}, ':', {i}) AS id, {role} AS role, {name} AS name, {src} AS name_source, {focus} AS focusable, {vis} AS visibility, {exp} AS expanded, {dis} AS disabled FROM nation" for i, role, name, src, focus, vis, exp, dis in NAMED))
def _(spark, sf):
    """Names and where they come from, states, focus and visibility of elements."""
    ax = html.ax_table(html.nodes(invokers(spark, sf)))
    known = F.regexp_extract("id", "[^:]+$", 0)
    rows = ax.where(known.rlike("^(b[0-9]+|p|q|t1|o|own)$"))
    return rows.select("id", "role", "name", "name_source", "focusable", "visibility", "states.expanded", "states.disabled")


@query(
    "n_relations",
    " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, concat('ax:', {PAGE}, ':', {a}) AS src, concat('ax:', {PAGE}, ':', {b}) AS dst FROM nation"
        for kind, a, b in (("commandfor", "'b' || n_nationkey", "'d'"), ("popovertarget", "'p'", "'o'"), ("aria-controls", "'t1'", "'pan'"), ("aria-controls", "'t2'", "'pan'"), ("aria-labelledBy", "'b' || n_nationkey", "'t'"), ("aria-labelledBy", "'pan'", "'t1'"), ("aria-owns", "'own'", "'q'"), ("a11y:child-of", "'l'", "'t1'"), ("a11y:child-of", "'l'", "'t2'"))
    ),
)
def _(spark, sf):
    """Edges of references, of attributes that name other elements, and of tab lists' children."""
    e = html.structure_edges(html.nodes(invokers(spark, sf)))
    return e.where((F.col("kind") != "a11y:child-of") | F.endswith("src", F.lit(":l"))).select("kind", "src", "dst")


DECLARED = (
    ("commandfor", "'b' || n_nationkey", "'ax:' || {p} || ':d'", "'open-modal'"), ("state:cause", "'b' || n_nationkey", "'state:TBD:commandfor:ax:' || {p} || ':b' || n_nationkey", "'open-modal'"),
    ("popovertarget", "'p'", "'ax:' || {p} || ':o'", "'click'"), ("state:cause", "'p'", "'state:TBD:popovertarget:ax:' || {p} || ':p'", "'click'"),
    ("tab-controls", "'t1'", "'ax:' || {p} || ':pan'", "'switch-tab'"), ("state:cause", "'t1'", "'state:TBD:apg-tab-activate:ax:' || {p} || ':t1'", "'switch-tab'"),
    ("tab-controls", "'t2'", "'ax:' || {p} || ':pan'", "'switch-tab'"), ("state:cause", "'t2'", "'state:TBD:apg-tab-activate:ax:' || {p} || ':t2'", "'switch-tab'"),
    ("state:cause", "'s'", "'state:TBD:choose-dropdown:ax:' || {p} || ':s'", "'choose-dropdown'"),
)


@query("n_declared_edges", " UNION ALL ".join(f"SELECT '{kind}' AS kind, concat('ax:', {PAGE}, ':', {src}) AS src, {dst.format(p=PAGE)} AS dst, {trigger} AS triggers FROM nation" for kind, src, dst, trigger in DECLARED))
def _(spark, sf):
    """Edges of declared relations with their triggers."""
    e = state.declared_edges(html.declared_records(html.nodes(invokers(spark, sf))))
    return e.select("kind", "src", "dst", F.array_join("triggers", "|").alias("triggers"))


@query(
    "f_declared_transitions",
    " UNION ALL ".join(f"SELECT concat('trans:{kind}:ax:', {PAGE}, ':', {src}, ':0') AS id, {trigger} AS trigger, {dst.format(p=PAGE)} AS targets FROM nation" for kind, src, dst, trigger in DECLARED if kind != "state:cause"),
)
def _(spark, sf):
    """Transitions of declared relations, numbered by kind and source."""
    t = state.declared_transitions(html.declared_records(html.nodes(invokers(spark, sf))))
    return t.select("id", "trigger", F.array_join("to_ax_ids", "|").alias("targets"))


@query("n_nav_structures", " UNION ALL ".join(f"SELECT concat('nav:', {PAGE}, ':{kind}:0') AS id, '{kind}' AS kind, {n} AS members, {active} AS active FROM nation" for kind, n, active in (("breadcrumb", 2, "'B'"), ("tablist", 2, "'One'"), ("menu", 2, "CAST(NULL AS VARCHAR)"))))
def _(spark, sf):
    """Navigation structures with the number of their members and the name of the active one."""
    found = html.nodes(invokers(spark, sf))
    names = html.ax_table(found).select(F.col("id").alias("active_member_ax_id"), F.col("name").alias("active"))
    return html.nav_elements(found).join(names, "active_member_ax_id", "left").select("id", "kind", F.size("member_ax_ids").alias("members"), "active")


CAPABLE = (("'save'", "'b' || n_nationkey", "'EXECUTE'", "'{}'"), ("'delete-it'", "'p'", "'CONFIRM'", "'{}'"), ("concat('search-', replace(lower(n_name), '_', '-'))", "'q'", "'PROPOSE'", "'{\"value\":{\"type\":\"string\"}}'"))


@query("n_capability_rows", " UNION ALL ".join(f"SELECT {name} AS name, concat('ax:', {PAGE}, ':', {at}) AS ax_id, {tier} AS security, {inputs} AS input_schema FROM nation" for name, at, tier, inputs in CAPABLE))
def _(spark, sf):
    """Capabilities of an invoker, a destructive button and a search box: name, tier and inputs."""
    c = html.capabilities(html.nodes(invokers(spark, sf)))
    at = F.regexp_extract("binding.ax_id", "[^:]+$", 0)
    return c.where(at.rlike("^(b[0-9]+|p|q)$")).select("name", "binding.ax_id", "security", "input_schema")


@query("n_declared_capabilities", "SELECT concat('cap:', n_name, ':declared') AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'READ' ELSE 'EXECUTE' END AS security, concat('cap-binding:', n_name) AS ax_id FROM nation")
def _(spark, sf):
    n = derive.table(spark, sf, "nation")
    tools = n.select(none().alias("page_id"), F.col("n_name").alias("name"), none().alias("description"), F.lit("{}").alias("input_schema"), none().alias("output_schema"), F.when(F.col("n_nationkey") % 2 == 0, "READ").alias("security"), none().alias("ax_id"), none().alias("selector"), F.col("n_nationkey").cast("long").alias("seq"))
    return html.declared_capabilities(tools).select("id", "security", "binding.ax_id")


@query("n_content_hash", "SELECT page_id, sha256(html) AS hash FROM pages")
def _(spark, sf):
    return derive.table(spark, sf, "pages").select("page_id", html.content_hash("html").alias("hash"))


@query("n_id_counts", f"WITH h AS (SELECT concat('page:', page_id) AS page_id, {BARE} AS h FROM pages) SELECT page_id, len(regexp_extract_all(h, '<(div|p|span|ul|li|nav|article|footer|h[1-6])[\\s>]')) AS n FROM h")
def _(spark, sf):
    """Elements of plain tags on each page."""
    found = html.nodes(page_table(spark, sf)).where(F.col("tag").isin("div", "p", "span", "ul", "li", "nav", "article", "footer", "h1", "h2", "h3", "h4", "h5", "h6"))
    counted = found.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    return page_table(spark, sf).select("page_id").join(counted, "page_id", "left").fillna(0)


FRONTIER = "e AS (SELECT DISTINCT concat('http://s.org/', cast(floor(page_id / 4) AS bigint)) AS src, concat(CASE WHEN page_id % 9 = 8 THEN 'http://other.org/' ELSE 'http://s.org/' END, page_id) AS dst, page_id AS seq FROM pages WHERE page_id > 0)"


@query("n_frontier", f"WITH RECURSIVE {FRONTIER}, r(url, hops) AS (SELECT 'http://s.org/0', 0 UNION ALL SELECT e.dst, hops + 1 FROM r JOIN e ON e.src = r.url WHERE starts_with(e.dst, 'http://s.org/')), k AS (SELECT url, CAST(hops AS INT) AS hops, CAST(split_part(url, '/', 4) AS BIGINT) AS n FROM r) SELECT url, hops FROM k ORDER BY n LIMIT 30")
def _(spark, sf):
    """The first pages that a crawl within one origin would visit."""
    p = derive.table(spark, sf, "pages").where("page_id > 0")
    dst = F.concat(F.when(F.col("page_id") % 9 == 8, "http://other.org/").otherwise("http://s.org/"), "page_id")
    links = p.select(F.concat(F.lit("http://s.org/"), F.floor(F.col("page_id") / 4)).alias("src"), dst.alias("dst"), F.col("page_id").cast("long").alias("seq"))
    return hierarchy.frontier(links, "http://s.org/0", 30).select("url", "hops")


@query("n_hierarchy_edges", "SELECT concat('p', cast(floor(page_id / 5) AS bigint)) AS src, concat('p', page_id) AS dst FROM pages WHERE page_id >= 5")
def _(spark, sf):
    """Edges to referring pages, where no URL is a prefix of another."""
    p = derive.table(spark, sf, "pages").select("page_id")
    url = lambda k: F.concat(F.lit("http://h"), k, F.lit(".org/"))
    rows = p.select(F.concat(F.lit("p"), "page_id").alias("id"), url(F.col("page_id")).alias("canonical_url"), F.when(F.col("page_id") >= 5, url(F.floor(F.col("page_id") / 5))).alias("referrer"), F.col("page_id").alias("seq"))
    return hierarchy.hierarchy_edges(hierarchy.parents(rows)).select("src", "dst")


@query("n_robots", "SELECT n_nationkey AS key, n_nationkey % 3 = 0 AS disallow_all FROM nation")
def _(spark, sf):
    body = F.concat(F.lit("# "), "n_name", F.lit("\nUser-agent: other\nDisallow: /\n\nUser-Agent: *  # all\nDisallow: "), F.when(F.col("n_nationkey") % 3 == 0, "/").otherwise("/private"), F.lit("\n"))
    return govern.robots(derive.table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), body.alias("body"))).select("key", "disallow_all")


@query("n_first_mismatch", "SELECT * FROM (VALUES ('equal', NULL), ('value', '$.a.b'), ('length', '$.c'), ('element', '$.c[1]'), ('extra', NULL)) t(what, path)")
def _(spark, sf):
    """Where an answer first lacks what was expected."""
    want = {"a": {"b": 1}, "c": [1, 2]}
    got = {"equal": want, "value": {"a": {"b": 2}, "c": [1, 2]}, "length": {"a": {"b": 1}, "c": [1]}, "element": {"a": {"b": 1}, "c": [1, 3]}, "extra": want | {"z": 0}}
    return spark.createDataFrame([(k, report.first_mismatch(want, v)) for k, v in got.items()], "what string, path string")


@query("n_discovery_report", "SELECT 'substrates/1' || string_agg(chr(10) || chr(10) || 'web' || n_nationkey || '  ' || CASE WHEN n_nationkey % 2 = 0 THEN 'AVAILABLE' ELSE 'OFF' END || '  ' || n_name || chr(10) || '  target t' || n_nationkey || '  ' || n_name || '  /' || chr(10) || '  capabilities: discover, inspect', '' ORDER BY n_nationkey) AS report FROM nation")
def _(spark, sf):
    n = derive.table(spark, sf, "nation").orderBy("n_nationkey").collect()  # a row a provider
    rows = [{"kind": f"web{r['n_nationkey']}", "available": r["n_nationkey"] % 2 == 0, "label": r["n_name"], "targets": [{"id": f"t{r['n_nationkey']}", "label": r["n_name"], "route": "/"}], "capabilities": ["discover", "inspect"]} for r in n]
    return spark.createDataFrame([(report.discovery_report(rows, "substrates/1"),)], "report string")


# states


@query("f_fingerprint", "SELECT count(*) AS n, TRUE AS same FROM events")
def _(spark, sf):
    """A state's visual fingerprint has the hash of its id."""
    from .catalogue import event_states

    s = state.with_ids(*event_states(spark, sf))
    return s.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.substring("id", 7, 64) == F.substring("visual_fingerprint", 4, 64)).alias("same"))


@query("f_augment", "SELECT event_id AS key, CASE WHEN event_id % 2 = 0 THEN TRUE ELSE user_id % 3 = 0 END AS expanded, CASE WHEN event_id % 5 = 0 THEN 'hidden' ELSE 'visible' END AS visibility FROM events")
def _(spark, sf):
    """Snapshot elements take the states of their accessibility node where they have none."""
    e = derive.table(spark, sf, "events")
    names = ("open", "selected", "checked", "pressed", "busy")
    snap = e.select(F.col("event_id").cast("string").alias("ax_id"), F.when(F.col("event_id") % 5 == 0, "hidden").alias("visibility"), F.when(F.col("event_id") % 2 == 0, True).alias("expanded"), *[none("boolean").alias(n) for n in names])
    ax = e.select(F.col("event_id").cast("string").alias("id"), F.struct((F.col("user_id") % 3 == 0).alias("expanded"), *[none("boolean").alias(n) for n in names]).alias("states"), F.lit("visible").alias("visibility"))
    return state.augment(snap, ax).select(F.col("ax_id").cast("long").alias("key"), "expanded", "visibility")


@query("f_rich_snapshots", "SELECT event_id AS key, event_id % 2 = 1 OR event_type = 'view' AS differs FROM events")
def _(spark, sf):
    """Captured snapshots before and after, read from JSON and compared: an element opens, a dialog appears."""
    e = derive.table(spark, sf, "events").select(F.col("event_id").alias("key"), "event_type")

    def record(opened, dialog):
        element = F.struct(F.lit("ax:1").alias("axId"), F.lit("visible").alias("visibility"), opened.alias("open"), F.lit(1.5).alias("zIndex"))
        return e.select("key", F.to_json(F.struct(F.lit(True).alias("online"), F.lit("1440x900").alias("viewport"), dialog.alias("dialogs"), F.create_map(F.lit("m"), F.lit("1")).alias("markers"), F.array(element).alias("elements"))).alias("snapshot"))

    empty = F.array().cast("array<string>")
    a, ea = state.rich_snapshots(record(F.lit(True), empty))
    b, eb = state.rich_snapshots(record(F.col("key") % 2 == 0, F.when(F.col("event_type") == "view", F.array(F.lit("d"))).otherwise(empty)))
    return state.snapshot_changes(a, b, ea, eb)


@query("f_legacy_diff", "SELECT event_id AS key, event_id % 2 = 0 AS differs FROM events")
def _(spark, sf):
    """Snapshots compared by the older rule, for which layers and focus do not count."""
    e = derive.table(spark, sf, "events").select(F.col("event_id").alias("key"))
    empty = F.array().cast("array<string>")
    shot = e.select("key", F.lit(True).alias("online"), empty.alias("open_dialog_ids"), empty.alias("open_popover_ids"), empty.alias("expanded_region_ax_ids"), F.lit("v").alias("viewport"), F.create_map(F.lit("m"), F.lit("1")).alias("conditional_markers"), none().alias("focused_ax_id"))
    part = lambda opened, layer: e.select("key", F.lit("ax:1").alias("ax_id"), F.lit("visible").alias("visibility"), opened.alias("open"), none("boolean").alias("expanded"), none("boolean").alias("selected"), none("boolean").alias("checked"), none("boolean").alias("pressed"), none("boolean").alias("busy"), layer.alias("z_index"), none("boolean").alias("focused"))
    return state.snapshot_changes(shot, shot, part(F.lit(True), F.lit(0.0)), part(F.col("key") % 2 != 0, F.lit(5.0)), state.LEGACY_COMPARED)


PROBES = (("click", "click", "click"), ("keyEnter", "key-enter", "command"), ("dialog-open", "open-modal", None), ("type", "type", None), ("drag", "drag", None))
APPLIES = {"click": ("button",), "keyEnter": ("button",), "dialog-open": ("button",), "type": ("textbox",), "drag": ()}


@query("f_probes", " UNION ALL ".join(f"SELECT '{p}' AS probe, event_id AS key, '{t}' AS trigger, {'NULL' if old is None else repr(old)} AS legacy, " + " OR ".join([f"(event_id % 2 = {['button', 'textbox'].index(r)})" for r in APPLIES[p]] or ["FALSE"]) + " AS applies FROM events" for p, t, old in PROBES))
def _(spark, sf):
    """Triggers of probes, by the newer and the older table, and whether they suit a button or a text box."""
    e = derive.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "button").otherwise("textbox").alias("role"))
    rows = e.withColumn("probe", F.explode(F.array(*[F.lit(p) for p, _, _ in PROBES])))
    return rows.select("probe", F.col("event_id").alias("key"), state.trigger_of("probe").alias("trigger"), state.trigger_of("probe", True).alias("legacy"), state.probe_applies("probe", "role", none()).alias("applies"))


@query("f_observed_transitions", "SELECT concat('trans:observed-', user_id, '-ax-click-', row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) AS id, 'click' AS trigger, concat('snapshot:', event_id) AS before FROM events")
def _(spark, sf):
    e = derive.table(spark, sf, "events")
    hits = e.select(F.col("user_id").cast("string").alias("page_id"), F.lit("ax").alias("ax_id"), F.lit("click").alias("probe"), F.col("event_id").cast("string").alias("before_hash"), F.lit("x").alias("after_hash"), F.col("event_id").alias("seq"))
    return state.observed_transitions(hits).select("id", "trigger", F.col("before_snapshot").alias("before"))


@query("f_auth_spec", "SELECT event_id AS key, CASE event_id % 5 WHEN 0 THEN 'anonymous' WHEN 1 THEN concat('authenticated:u', user_id) WHEN 2 THEN concat('administrator:u', user_id, ':s1') WHEN 3 THEN concat('custom-role:editor:u', user_id) END AS printed, CASE event_id % 5 WHEN 0 THEN 'auth:anonymous' WHEN 1 THEN concat('auth:authenticated:u', user_id, ':') WHEN 2 THEN concat('auth:administrator:u', user_id, ':s1') WHEN 3 THEN concat('auth:custom-role:editor:u', user_id, ':') END AS id FROM events")
def _(spark, sf):
    """Authentication specs read, printed again and named; one in five is none."""
    e, k, u = derive.table(spark, sf, "events"), F.col("event_id") % 5, F.concat(F.lit("u"), "user_id")
    spec = F.when(k == 0, " anonymous ").when(k == 1, F.concat(F.lit("authenticated:"), u)).when(k == 2, F.concat(F.lit("administrator:"), u, F.lit(":s1"))).when(k == 3, F.concat(F.lit("custom-role:editor:"), u)).otherwise("authenticated:")
    a = e.select(F.col("event_id").alias("key"), state.parse_auth(spec).alias("a"))
    return a.select("key", F.when(F.col("a").isNotNull(), state.print_auth(F.col("a"))).alias("printed"), F.when(F.col("a").isNotNull(), state.auth_id("a.kind", "a.role", "a.principal", "a.session")).alias("id"))


@query("f_handshakes", "SELECT concat('hitl:', sha256(concat('state:', event_id, '|sms-totp'))) AS id, CASE WHEN event_id % 2 = 0 THEN 'cleared' ELSE 'pending' END AS status FROM events WHERE event_type = 'error'")
def _(spark, sf):
    e = derive.table(spark, sf, "events").where("event_type = 'error'")
    found = e.select(F.lit("sms-totp").alias("kind"), F.lit("code").alias("prompt"), F.concat(F.lit("state:"), "event_id").alias("state_id"), F.lit("p").alias("page_id"), "event_id")
    opened = state.handshakes(found)
    cleared = state.handshakes(found.where("event_id % 2 = 0")).select("id", F.lit("now").alias("at"))
    return state.resolve_handshakes(opened, cleared).select("id", "status")


# governance

CALLS = (
    ("graph.query", "graph_query", "read"), ("graph.liveRead", "graph_query", "read"), ("graph_invoke", "invoke_capability", "modify"), ("authorize_operation", "authorize", "modify"), ("substrate.info", "diagnostics", "read"),
    ("lint_tokens", "token_lint", "read"), ("export_tokens", "token_export", "exfiltrate"), ("crawl_start", "crawl", "modify"), ("desktop_read_text", "desktop_read", "read"), ("mobile_touch_action", "mobile_act", "modify"),
    ("chrome_get_cookies", "chrome_cookies", "exfiltrate"), ("graph.occludedNodes", "visual_read", "read"), ("audit.export", "audit_export", "exfiltrate"), ("rm -rf", None, None),
)
CALL_ROWS = "(VALUES " + ", ".join(f"({i}, '{a}', {'NULL' if o is None else repr(o)}, {'NULL' if m is None else repr(m)})" for i, (a, o, m) in enumerate(CALLS)) + ") t(i, tool, operation, impact)"


def calls(spark, sf) -> DataFrame:
    """Attempts: an event each, with one of the tools."""
    tool = F.element_at(F.array(*[F.lit(a) for a, _, _ in CALLS]), (F.col("event_id") % len(CALLS) + 1).cast("int"))
    return derive.table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), tool.alias("tool"), (F.col("user_id") % 7).cast("string").alias("principal"), derive.epoch_ms("ts").alias("at_ms"), F.lit("web").alias("substrate"),
        F.when(F.col("user_id") % 4 == 0, "https://other.example.com/x").otherwise("https://app.example.com/a/b").alias("target"), F.when(F.col("event_id") % 3 == 0, "https://app.example.com").alias("cookie_origin"),
        F.when(F.col("event_id") % 2 == 0, "sid").otherwise("other").alias("cookie"), (F.col("event_id") % 5 == 0).alias("confirm"),
    )


@query("g_operations", f"SELECT event_id AS seq, operation, impact FROM events JOIN {CALL_ROWS} ON i = event_id % {len(CALLS)}")
def _(spark, sf):
    """What tools and methods stand for, and how much they may do; an unknown one stands for nothing."""
    return calls(spark, sf).select("seq", govern.operation_of("tool").alias("operation")).withColumn("impact", govern.impact_of("operation"))


REGISTRY = {
    "read": "graph_query graph_path graph_tool graph_explain audit_read diagnostics visual_diff visual_read visual_query token_lint desktop_read chrome_read mobile_read system_doctor manifest_snapshot",
    "exfiltrate": "audit_export token_export auth_capture session_capture chrome_cookies",
    "modify": "graph_act invoke_capability posture_escalate posture_deescalate posture_revoke authorize crawl desktop_act mobile_act chrome_act",
}


@query("g_registry", " UNION ALL ".join(f"SELECT '{op}' AS operation, '{impact}' AS impact" for impact, ops in REGISTRY.items() for op in ops.split()))
def _(spark, sf):
    """The thirty operations and their impacts."""
    ops = spark.createDataFrame([(op,) for op in govern.ALIASES], "operation string")
    return ops.select("operation", govern.impact_of("operation").alias("impact"))


@query(
    "g_gateway",
    f"WITH c AS (SELECT event_id AS seq, operation, impact, count(operation) OVER (PARTITION BY user_id % 7 ORDER BY epoch_ms(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS n, event_id % 3 = 0 AND event_id % 2 = 1 AS no_cookie, user_id % 4 = 0 AS off, event_id % 5 = 0 AS confirm FROM events JOIN {CALL_ROWS} ON i = event_id % {len(CALLS)}) "
    "SELECT seq, CASE WHEN operation IS NULL THEN 'unknown_operation' WHEN n > 40 THEN 'rate_limited' WHEN no_cookie THEN 'cookie_grant_denied' WHEN off OR impact = 'exfiltrate' THEN 'posture_denied' END AS autopilot, "
    "CASE WHEN operation IS NULL THEN 'unknown_operation' WHEN n > 40 THEN 'rate_limited' WHEN no_cookie THEN 'cookie_grant_denied' WHEN impact <> 'read' AND NOT confirm THEN 'escalation_required' END AS copilot FROM c",
)
def _(spark, sf):
    """Why attempts are denied, by the steps' order: operation, rate, cookie grant, posture, approval."""
    grants = spark.createDataFrame([("https://app.example.com", "s*", 10**15, False), ("https://app.example.com", "other", 10**15, True)], "origin string, cookie_pattern string, expires_at long, revoked boolean")
    scope = {"max_substrates": ["web"], "operations": ["*"], "targets": ["app.example.com/a"], "max_impact": "modify"}
    a = calls(spark, sf)
    known = govern.measured(a, limit=40, window_ms=60_000_000, grants=grants, now_ms=0)
    first = govern.judge(known, "autopilot", scope).withColumnRenamed("denial", "autopilot")
    return govern.judge(first, "copilot").select("seq", "autopilot", F.col("denial").alias("copilot"))


@query("g_gateway_audit", f"SELECT operation, count(*) AS n FROM events JOIN {CALL_ROWS} ON i = event_id % {len(CALLS)} WHERE impact = 'read' GROUP BY operation")
def _(spark, sf):
    """Audit events of allowed attempts, by operation."""
    done = govern.gateway(calls(spark, sf).drop("cookie_origin"), "audit", None, limit=10**9)
    return govern.audit_events(done, stream="principal").where("allowed").groupBy("operation").agg(F.count(F.lit(1)).alias("n"))


@query("g_chain_breaks", "SELECT CAST(user_id % 16 AS VARCHAR) AS stream_id, count(*) AS n, CASE WHEN user_id % 16 = 3 THEN 1 ELSE 0 END AS broken FROM events GROUP BY user_id % 16")
def _(spark, sf):
    """Lengths of audit chains, and how many of their links are broken after one event of one stream was changed."""
    e = derive.table(spark, sf, "events").select((F.col("user_id") % 16).cast("string").alias("stream_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("body"))
    chain = govern.audit_chain(e)
    changed = chain.withColumn("hash", F.when((F.col("stream_id") == "3") & (F.col("sequence") == 1), "0").otherwise(F.col("hash")))
    broken = govern.broken_links(changed).groupBy("stream_id").agg(F.count(F.lit(1)).alias("broken"))
    return chain.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n")).join(broken, "stream_id", "left").select("stream_id", "n", F.coalesce("broken", F.lit(0)).cast("int").alias("broken"))


CHAINED = "'{\"body\":\"' || event_type || '\",\"prev_hash\":\"\",\"sequence\":1,\"stream_id\":\"' || user_id % 16 || '\"}'"


@query("g_chain_heads", f"SELECT CAST(user_id % 16 AS VARCHAR) AS stream_id, sha256({CHAINED}) AS hash FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) = 1")
def _(spark, sf):
    """The first hash of each audit chain."""
    e = derive.table(spark, sf, "events").select((F.col("user_id") % 16).cast("string").alias("stream_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("body"))
    return govern.audit_chain(e).where("sequence = 1").select("stream_id", "hash")


@query("g_hashes", "SELECT 'manifest' AS what, sha256('{\"graphHash\":\"g\",\"posture\":\"audit\"}') AS hash UNION ALL SELECT 'scope', substr(sha256('{\"targets\":[\"a\"],\"operations\":[\"*\"]}'), 1, 16)")
def _(spark, sf):
    rows = [("manifest", govern.manifest_hash({"posture": "audit", "graphHash": "g"})), ("scope", govern.scope_hash({"targets": ["a"], "operations": ["*"]}))]
    return spark.createDataFrame(rows, "what string, hash string")


@query("g_manifest_revisions", "SELECT n_nationkey AS key, 1 + n_nationkey % 4 AS revision, sha256(concat('{\"description\":\"', n_name, '\",\"graphHash\":\"g\"}')) AS hash FROM nation")
def _(spark, sf):
    """Manifests after some refreshes: the revision counts them, the hash is of what they say."""
    out = []
    for r in derive.table(spark, sf, "nation").collect():  # a row a manifest
        m = {"description": r["n_name"], "graphHash": "g", "revision": 1}
        for _ in range(r["n_nationkey"] % 4):
            m = govern.refresh_manifest(m)
        out.append((r["n_nationkey"], m["revision"], govern.manifest_hash({k: v for k, v in m.items() if k != "revision"})))
    return spark.createDataFrame(out, "key int, revision int, hash string")


@query("g_cookies", "SELECT event_id AS key, event_id % 2 = 0 AND (event_id % 4 = 0 OR event_type = 'view') AS granted FROM events")
def _(spark, sf):
    """Cookies granted by origin and name pattern; expired and revoked grants give nothing."""
    e = derive.table(spark, sf, "events")
    asks = e.select(F.col("event_id").alias("key"), F.when(F.col("event_id") % 2 == 0, "https://a").otherwise("https://b").alias("origin"), F.when(F.col("event_id") % 4 == 0, "SID_1").otherwise(F.col("event_type")).alias("cookie"))
    grants = spark.createDataFrame([("https://a", "sid*", 100, False), ("https://a", "view", 100, False), ("https://a", "click", 5, False), ("https://b", "*", 100, True)], "origin string, cookie_pattern string, expires_at long, revoked boolean")
    return govern.cookies_granted(asks, grants, 10).select("key", "granted")


@query("g_dispatch", "SELECT event_id AS key, CASE WHEN event_id % 2 = 0 THEN 'https://u' WHEN event_id % 3 = 0 THEN concat('page:', user_id) ELSE 'graph' END AS target, CASE event_id % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'modify' ELSE 'destroy' END AS impact FROM events")
def _(spark, sf):
    """What a request is about, and the impact of its capability's tier."""
    e, k = derive.table(spark, sf, "events"), F.col("event_id")
    tier = F.when(k % 3 == 0, "READ").when(k % 3 == 1, "EXECUTE").otherwise("CONFIRM")
    target = govern.request_target(F.when(k % 2 == 0, "https://u").otherwise(""), F.when(k % 3 == 0, F.concat(F.lit("page:"), "user_id")))
    return e.select(k.alias("key"), target.alias("target"), govern.tier_impact(tier).alias("impact"))


@query("g_action_limit", "SELECT event_id AS seq, row_number() OVER (ORDER BY event_id) <= 25 AS allowed FROM events")
def _(spark, sf):
    """An authorization for a number of actions ends with it."""
    e = derive.table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.lit("web").alias("substrate"), F.lit("graph_act").alias("operation"), F.lit("modify").alias("impact"), F.lit("https://a.org/").alias("target"))
    scope = {"max_substrates": ["web"], "operations": ["*"], "targets": ["*"], "max_impact": "modify", "max_actions": 25}
    return govern.check_posture(e, "autopilot", scope).select("seq", "allowed")


@query("g_authorization", "SELECT * FROM (VALUES ('good', TRUE, 'valid'), ('revoked', FALSE, 'revoked'), ('expired', FALSE, 'expired'), ('unsigned', FALSE, 'signature')) t(what, valid, reason)")
def _(spark, sf):
    """Authorizations: as many signatures as approvers, not expired, not revoked."""
    rows = [("good", ["a"], ["s"], 100, False), ("revoked", ["a"], ["s"], 100, True), ("expired", ["a"], ["s"], 5, False), ("unsigned", ["a", "b"], ["s", ""], 100, False)]
    df = spark.createDataFrame(rows, "what string, approvers array<string>, signatures array<string>, expires_at long, revoked boolean")
    return govern.authorization_state(df, 10).select("what", "valid", "reason")


@query("s_auth_state", "SELECT 'same version' AS what, 'ok' AS outcome UNION ALL SELECT 'other version', 'AUTH_STATE_VERSION'")
def _(spark, sf):
    """Session files: one of another version is refused."""
    rows = []
    for what, version in (("same version", "1.0.0"), ("other version", "2")):
        path = working_folder(spark, "session")
        spark.createDataFrame([(json.dumps({"version": version, "cookies": []}),)], "value string").coalesce(1).write.text(path)
        try:
            graph_json.auth_state(spark, path)
            rows.append((what, "ok"))
        except graph_json.SubstrateError as e:
            rows.append((what, e.code))
    return spark.createDataFrame(rows, "what string, outcome string")


@query("k_job_key", "SELECT substr(sha256('http://x|same-origin|50|out'), 1, 16) AS key")
def _(spark, sf):
    return spark.createDataFrame([(graph_json.job_key("http://x", "same-origin", 50, "out"),)], "key string")
