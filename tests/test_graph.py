"""The catalog, requests and traversal on small hand-made graphs."""

import json
import re

import pytest
from pyspark.sql import functions as F

from surfacegraph import api, catalogue
from surfacegraph.operators import govern, layout, occlusion, report, select, state, traverse
from surfacegraph.plans import derive
from surfacegraph.plans.schema import page_of_ax
from surfacegraph.sources import graph_json, html, trees

DOC = {
    "version": "1.0.0",
    "crawl": {"rootUrl": "http://x/"},
    "designTokens": {"color": {"$type": "color", "accent": {"$value": "#0a0", "$type": "color"}}, "size": {"s": {"$value": 8, "$type": "number"}}},
    "pages": [{"id": "page:http://x/", "url": "http://x/", "title": "Home", "canonicalUrl": "http://x/", "loadStatus": "complete"}, {"id": "page:http://x/b", "url": "http://x/b", "title": "B", "canonicalUrl": "http://x/b", "loadStatus": "timeout"}],
    "axNodes": [
        {"id": "ax:1", "pageId": "page:http://x/", "role": "tab", "name": "Recent", "states": {"selected": True, "current": True}, "focusable": True},
        {"id": "ax:2", "pageId": "page:http://x/", "role": "button", "name": "New ticket", "states": {"expanded": None}},
        {"id": "ax:3", "pageId": "page:http://x/b", "role": "button", "name": ""},
        {"id": "ax:2", "pageId": "page:http://x/", "role": "button", "name": "New ticket 2", "states": {}},
    ],
    "visualNodes": [
        {"id": "vis:1", "axId": "ax:1", "pageId": "page:http://x/", "rect": {"x": 0, "y": 0, "w": 10, "h": 10}, "computedStyle": {"position": "sticky", "background-color": "red"}, "designTokenRefs": [], "tethers": {"parent": None, "children": ["ax:2"]}},
        {"id": "vis:2", "axId": "ax:2", "pageId": "page:http://x/", "rect": {"x": 5, "y": 5, "w": 10, "h": 10}, "computedStyle": {}, "designTokenRefs": ["color.accent"], "tethers": {"parent": "ax:1", "children": []}},
    ],
    "edges": [
        {"id": "edge:ax:1->ax:2:aria-controls", "from": "ax:1", "to": "ax:2", "kind": "aria-controls"},
        {"id": "edge:ax:2->ax:3:link", "from": "ax:2", "to": "ax:3", "kind": "link"},
        {"id": "edge:page:http://x/->page:http://x/b:nav:child-of", "from": "page:http://x/", "to": "page:http://x/b", "kind": "nav:child-of"},
    ],
    "capabilities": [{"id": "cap:1", "name": "create_ticket", "pageId": "page:http://x/", "security": "EXECUTE", "binding": {"kind": "ax-node", "axId": "ax:2"}}, {"id": "cap:2", "name": "delete_ticket", "pageId": "page:http://x/", "security": "CONFIRM", "binding": {"kind": "ax-node", "axId": "ax:2"}}],
    "transitions": [],
    "states": [{"id": "state:1", "pageId": "page:http://x/", "payload": {"route": "/home", "openDialogIds": ["d1"], "elements": {"ax:1": {"visibility": "visible"}}}, "authContext": {"kind": "anonymous"}, "networkContext": {"status": "online", "evidence": "observed"}, "evidence": [{"kind": "declared", "sourceAxId": "ax:1", "at": "t"}]}],
    "authContexts": [{"id": "auth:anonymous", "context": {"kind": "anonymous"}, "observationCount": 2}],
    "navElements": [{"id": "nav:1", "pageId": "page:http://x/", "kind": "menu", "containerAxId": "ax:1", "memberAxIds": ["ax:2", "ax:1"], "name": "User menu"}],
}


@pytest.fixture(scope="module")
def graph(spark):
    return graph_json.from_document(spark, DOC)


def ids(graph, kind, **where):
    return [h["node"]["id"] for h in select.hits(graph, kind, where)["hits"]]


def test_upsert_is_last_wins_in_first_place(graph):
    assert [(r["id"], r["name"]) for r in graph.ax.orderBy("seq").collect()] == [("ax:1", "Recent"), ("ax:2", "New ticket 2"), ("ax:3", "")]


def test_predicates(graph):
    assert ids(graph, "ax-node", role="button") == ["ax:2", "ax:3"]
    assert ids(graph, "ax-node", name="ticket") == ["ax:2"] and ids(graph, "ax-node", name="Ticket") == []
    assert ids(graph, "ax-node", name=re.compile("TICKET", re.I)) == ["ax:2"]
    assert ids(graph, "ax-node", state={"selected": True}) == ["ax:1"] and ids(graph, "ax-node", state={"current": True}) == ["ax:1"]
    assert ids(graph, "ax-node", state={"selected": None}) == ["ax:2", "ax:3"]
    assert ids(graph, "ax-node", pageUrl="/b") == ["ax:3"]
    assert ids(graph, "ax-node", hasCapability="CREATE*") == ["ax:1", "ax:2"]
    assert ids(graph, "ax-node", designToken="color.accent") == ["ax:2"]
    assert ids(graph, "visual-node", inTether={"axId": "ax:1", "relation": "children"}) == ["vis:2"]
    assert ids(graph, "ax-node", reachableFrom={"axId": "ax:1", "maxHops": 1}) == ["ax:2"]
    assert ids(graph, "visual-node", visualStyle={"backgroundColor": "red"}) == ["vis:1"]
    assert ids(graph, "ax-node", visualStyle={"backgroundColor": "none"}) == ["ax:1", "ax:2", "ax:3"]
    assert ids(graph, "visual-node", minVisibleRatio=0.5) == ["vis:1", "vis:2"] and ids(graph, "visual-node", isOccluded=True) == []
    assert ids(graph, "visual-node", hasTokenBinding=True) == ["vis:2"] and ids(graph, "visual-node", tokenPath="x") == []
    assert ids(graph, "nav-element", navKind="menu", name="User") == ["nav:1"]
    assert ids(graph, "state", stateHasOpenDialog="d1", stateAuthKind="anonymous") == ["state:1"] and ids(graph, "state", stateRoute="nope") == []
    assert ids(graph, "page", name="Home") == ["page:http://x/"]
    assert ids(graph, "edge") == ["edge:ax:1->ax:2:aria-controls", "edge:ax:2->ax:3:link"]
    with pytest.raises(ValueError):
        select.Where.parse({"nonsense": 1})


def test_any_and_limits(graph):
    got = select.hits(graph, "any", {}, 4)
    assert [h["select"] for h in got["hits"]] == ["ax-node"] * 3 + ["visual-node"] and got["truncated"] and got["remaining"] == -1
    assert select.hits(graph, "page", {}, 2)["truncated"] is False


def test_traversal(graph):
    path = traverse.find_ax_path(graph, "ax:1", "ax:3")
    assert path["cost"] == 2 and [h["via"] for h in path["hops"]] == ["aria-controls", "link"]
    assert traverse.find_ax_path(graph, "ax:1", "ax:9")["cost"] == -1 and traverse.find_ax_path(graph, "ax:1", "ax:1")["found"]
    assert traverse.relate(graph, "page:http://x/", "path", "page:http://x/b")["cost"] == 1
    assert [r["id"] for r in traverse.relate(graph, "page:http://x/", "children").collect()] == ["page:http://x/b"]
    assert [r["id"] for r in traverse.relate(graph, "page:http://x/b", "ancestors").collect()] == ["page:http://x/"]
    assert traverse.relate(graph, "state:1", "children").count() == 0
    assert [r["id"] for r in traverse.menu(graph, "ax:1").collect()] == ["ax:2", "ax:1"]


def test_ties_go_to_the_first_parent(spark):
    edges = spark.createDataFrame([("a", "c", 2), ("a", "b", 1), ("c", "d", 0), ("b", "d", 9), ("d", "a", 3)], "src string, dst string, seq long").withColumns({"kind": F.lit("k"), "provenance": F.lit("p")})
    tree = {r["id"]: (r["hops"], r["rank"], r["parent"]) for r in traverse.search(edges, "a", None, 5).collect()}
    assert tree["b"][:2] == (1, 1) and tree["c"][:2] == (1, 2) and tree["d"] == (2, 1, "b")


def test_document_round_trip_and_store(spark, graph, tmp_path):
    doc = graph_json.to_document(graph)
    assert doc["designTokens"] == {"color": {"accent": {"$value": "#0a0", "$type": "color"}}, "size": {"s": {"$value": 8, "$type": "number"}}}
    assert [a["name"] for a in doc["axNodes"]] == ["Recent", "New ticket 2", ""]
    path = str(tmp_path / "g")
    graph_json.save(graph, path)
    again = graph_json.load(spark, path)
    assert again.ax.count() == 3 and again.edges.where("kind = 'link'").count() == 1 and again.auth.count() == 1
    with pytest.raises(graph_json.SubstrateError, match="SUBSTRATE_EXISTS"):
        graph_json.save(graph, path)
    with pytest.raises(graph_json.SubstrateError, match="SUBSTRATE_MISSING"):
        graph_json.load(spark, path + "x")
    with pytest.raises(graph_json.SubstrateError, match="SUBSTRATE_INVALID"):
        graph_json.from_document(spark, {"version": "2"})
    (tmp_path / "g.json").write_text(json.dumps(DOC))
    assert graph_json.read_document(spark, str(tmp_path / "g.json")).pages.count() == 2


def test_reports(graph):
    a, b = report.loading_health(graph).first(), report.penalty_health(graph).first()
    assert (a["pages_total"], a["pages_failed"], a["health_score"], a["unlabeled"]) == (2, 1, 50, 1)
    assert (b["health_score"], b["pages_without_tree"]) == (74, 0)
    assert report.tabs(graph).first()["panel_name"] == "New ticket 2"
    assert report.call_to_action(graph).first()["ax_id"] == "ax:2"
    assert [r["vis_id"] for r in report.sticky(graph).collect()] == ["vis:1"]
    assert report.first_mismatch({"a": [1, {"b": 2}]}, {"a": [1, {"b": 2, "c": 3}]}) is None and report.first_mismatch({"a": [1]}, {"a": [2]}) == "$.a[0]"


@pytest.mark.parametrize("method,params", [("graph_query", {"select": "page"}), ("graph.path", {"from": "ax:1", "to": "ax:3"}), ("graph_tool", {"securityAtMost": "EXECUTE"}), ("graph_act", {"capabilityId": "cap:2"}), ("graph_explain", {"id": "ax:1"}), ("graph_diagnostics", {}), ("summary", {}), ("inspect", {}),
                                            ("get_visual", {"axId": "ax:1"}), ("get_visual_patterns", {}), ("get_visual_containers", {}), ("get_spatial_neighbors", {"visId": "vis:1"}), ("get_occluded_nodes", {}), ("query_visual_regression", {}), ("lint_design_tokens", {}), ("export_dtcg_tokens", {}), ("substrate_info", {}), ("query_viewport_diff", {"from": "a", "to": "b"}), ("query_page_layout_mutations", {"from": "a", "to": "b"})])
def test_every_method_answers(graph, method, params):
    got = api.dispatch(graph, method, params)
    assert "result" in got, got


def test_errors_have_codes(graph):
    assert api.dispatch(graph, "nope")["error"]["code"] == -32601
    assert api.dispatch(graph, "graph_act", {})["error"]["code"] == -32602
    assert api.dispatch(graph, "graph_act", {"capabilityId": "x"})["error"]["code"] == -32004
    assert json.loads(api.handle(graph, "{"))["error"]["code"] == -32700
    assert json.loads(api.handle(graph, '{"id": 3, "method": "graph_query", "params": {"select": "page"}}'))["id"] == 3


HTML = """<!doctype html><html><body><nav aria-label="Main"><a href="/a">A <b>bold</a><a href="#x">X</a></nav><main><h2>Hi</h2>
<label>Name <input type=text></label><input id=q placeholder="Find"><label for=q>Query</label><img alt=""><button aria-expanded=false commandfor=d command=show-modal>Open</button>
<dialog id=d open>D</dialog><div role=tablist><button role=tab id=t1 aria-controls=p1 aria-selected=true>One</button></div><ul><li>1<li>2</ul><script>var a="</p><a href='z'>"</script></main></body></html>"""


def test_html_walk(spark):
    pages = spark.createDataFrame([("page:http://x/", "http://x/", HTML)], "page_id string, url string, html string")
    found = html.nodes(pages).cache()
    rows = found.orderBy("node_index").collect()
    by = {}
    for r in rows:
        by.setdefault(r["role"], []).append(r)
    assert [r["name"] for r in by["textbox"]] == ["Name", "Query"] and [r["name_source"] for r in by["textbox"]] == ["label", "label"]
    assert [r["name"] for r in by["link"]] == ["A bold", "X"] and len(by["listitem"]) == 2
    assert by["heading"][0]["properties"]["level"] == 2 and by["navigation"][0]["name"] == "Main"
    assert by["dialog"][0]["states"]["open"] is True and by["button"][0]["apg_pattern"] == "disclosure"
    assert [(r["raw_href"], r["link_kind"]) for r in html.links(found).orderBy("node_index").collect()] == [("/a", "same-origin"), ("#x", "anchor")]
    edges = html.structure_edges(found)
    assert edges.where("kind = 'a11y:child-of'").count() == len(rows) - 1 and edges.where("kind = 'aria-controls'").first()["dst"] == "ax:page:http://x/:p1"
    assert [(r["kind"], len(r["member_ax_ids"])) for r in html.nav_elements(found).orderBy("kind").collect()] == [("nav", 2), ("tablist", 1)]
    kinds = [r["kind"] for r in html.declared_records(found).orderBy("seq").collect()]
    assert kinds.count("state:cause") == 2 and "commandfor" in kinds and "tab-controls" in kinds
    assert {r["name"] for r in html.capabilities(found).collect()} >= {"open", "one", "name"}


def test_platform_trees(spark):
    win = {"ControlType": "ControlType.Window", "Name": "W", "Children": [{"controlType": "UIA_ButtonControlTypeId", "name": "OK", "isOffscreen": True}]}
    rows = trees.trees(spark.createDataFrame([("p", "u", json.dumps(win))], "page_id string, url string, tree string"), "windows").orderBy("node_index").collect()
    assert [(r["role"], r["name"], r["visibility"], r["parent_index"]) for r in rows] == [("dialog", "W", "visible", None), ("button", "OK", "offscreen", 0)]
    xml = '<hierarchy><node class="android.widget.RadioButton" text="" content-desc="Pick" bounds="[0,0][10,20]" clickable="true" checked="true"><node class="android.widget.TextView" text="T"/></node></hierarchy>'
    rows = trees.trees(spark.createDataFrame([("p", "u", xml)], "page_id string, url string, tree string"), "android-xml").orderBy("node_index").collect()
    assert [(r["role"], r["name"]) for r in rows] == [("generic", ""), ("button", "Pick"), ("text", "T")]
    assert trees.macos_role("AXPopUpButton") == "combobox" and trees.ios_role("XCUIElementTypeSecureTextField") == "textbox" and trees.android_role("x.TextView", True) == "button"
    flat = [("p", "1", None, "RootWebArea", "r", False, 0), ("p", "2", "1", "generic", "", True, 1), ("p", "3", "2", "button", "b", False, 2)]
    got = trees.cdp(spark.createDataFrame(flat, "page_id string, node_id string, parent_id string, role string, name string, ignored boolean, seq long")).orderBy("node_index").collect()
    assert [(r["node_id"], r["parent_id"], r["role"]) for r in got] == [("1", None, "document"), ("3", "1", "button")]


def test_occlusion_respects_clipping_and_family(spark):
    none = None
    rows = [("p", "box", none, (0.0, 0.0, 100.0, 100.0), {"overflow": "hidden"}, 0), ("p", "kid", "box", (50.0, 0.0, 100.0, 100.0), {"zIndex": "5"}, 1), ("p", "over", none, (0.0, 0.0, 50.0, 100.0), {"zIndex": "9"}, 2), ("p", "far", none, (5000.0, 0.0, 5.0, 5.0), {}, 3)]
    df = spark.createDataFrame(rows, "page_id string, id string, parent string, rect struct<x:double,y:double,w:double,h:double>, style map<string,string>, seq long").withColumns(
        {"padding_box": F.lit(None).cast("struct<x:double,y:double,w:double,h:double>"), "is_scroll": F.lit(False), "is_stacking": F.lit(False), "z": F.lit(None).cast("int"), "has_children": F.lit(False)})
    got = {r["id"]: r for r in occlusion.occlusion(df).collect()}
    assert got["box"]["visible_ratio"] == 0.5 and got["box"]["occluded_by"] == ["over"]
    assert got["kid"]["visible_area"] == 5000 and got["kid"]["visible_ratio"] == 0.5 and got["far"]["is_offscreen"] and got["far"]["is_occluded"]


def test_occlusion_walks_chains_of_more_than_64_nodes(spark):
    box = (0.0, 0.0, 100.0, 100.0)
    rows = [("p", "n0", None, (0.0, 0.0, 40.0, 100.0), {"overflow": "hidden"}, 0)] + [("p", f"n{i}", f"n{i - 1}", box, {"zIndex": "9"} if i == 70 else {}, i) for i in range(1, 71)]
    df = spark.createDataFrame(rows, "page_id string, id string, parent string, rect struct<x:double,y:double,w:double,h:double>, style map<string,string>, seq long").withColumns(
        {"padding_box": F.lit(None).cast("struct<x:double,y:double,w:double,h:double>"), "is_scroll": F.lit(False), "is_stacking": F.lit(False), "z": F.lit(None).cast("int"), "has_children": F.lit(False)})
    conf, old = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(conf, "1")
    try:
        assert occlusion.ancestors(df.select("id", "parent")).count() == 70 * 71 // 2
        got = {r["id"]: r for r in occlusion.clipped(df).select("id", "clip.w").collect()}
        assert {r["w"] for r in got.values()} == {40.0}
        assert all(r["occluded_by"] == [] for r in occlusion.occlusion(df).select("occluded_by").collect())
        with pytest.raises(ValueError):
            occlusion.ancestors(spark.createDataFrame([("a", "c"), ("b", "a"), ("c", "b"), ("d", "a")], "id string, parent string"))
    finally:
        spark.conf.set(conf, old)


def test_components_of_the_whole_table_match_a_flood_fill(spark):
    sf = "/root/testdata/sf0.001"
    pages = {}
    for r in derive.visual(spark, sf, large=True).select("page_id", "seq", "rect").collect():
        pages.setdefault(r["page_id"], {})[r["seq"]] = r["rect"]
    shared = lambda a, s, b, t: min(a + s, b + t) - max(a, b)
    want = set()
    for page, boxes in pages.items():
        free = set(boxes)
        while free:
            group, todo = set(), [min(free)]
            while todo:
                a = todo.pop()
                free.discard(a)
                group.add(a)
                p = boxes[a]
                near = {b for b in free if shared(p["x"], p["w"], boxes[b]["x"], boxes[b]["w"]) >= 24 and shared(p["y"], p["h"], boxes[b]["y"], boxes[b]["h"]) >= 24}
                free -= near
                todo += near
            if len(group) > 1:
                want.add((page, f"v{min(group)}", len(group), min(95, max(40, 30 + len(group) * 8))))
    got = [tuple(r) for r in catalogue.queries()["l_components"](spark, sf).select("page_id", "group_id", "members", "confidence").collect()]
    assert len(got) == len(want) and set(got) == want
    assert sum(g[2] for g in got) > sum(map(len, pages.values())) / 2


def test_state_ids_ignore_positions_and_order(spark):
    base = {"key": 1, "page_id": "p", "route": "/", "auth_kind": "anonymous", "network_status": "online", "network_evidence": "o", "open_dialog_ids": ["b", "a"], "open_popover_ids": [], "expanded_region_ax_ids": [], "viewport": (1440.0, 900.0, 2.0, 0.0, 0.0004)}
    other = base | {"key": 2, "open_dialog_ids": ["a", "b"], "viewport": (1440.0, 900.0, 2.0, 0.0, 0.0)}
    third = base | {"key": 3, "focused_ax_id": "ax:1"}
    schema = "key int, page_id string, route string, auth_kind string, auth_role string, principal string, session string, network_status string, network_evidence string, viewport struct<w:double,h:double,dpr:double,scroll_x:double,scroll_y:double>, focused_ax_id string, open_dialog_ids array<string>, open_popover_ids array<string>, expanded_region_ax_ids array<string>, conditional_markers map<string,string>"
    states = spark.createDataFrame([base, other, third], schema)
    el = spark.createDataFrame([(k, a, "visible", None, None, None, None, None, None) for k in (1, 2, 3) for a in (["x", 'y"'] if k == 1 else ['y"', "x"])], "key int, ax_id string, visibility string, open boolean, expanded boolean, selected boolean, checked boolean, pressed boolean, busy boolean")
    got = {r["key"]: r for r in state.with_ids(states, el).collect()}
    assert got[1]["id"] == got[2]["id"] != got[3]["id"] and got[1]["visual_fingerprint"][3:] == got[1]["id"][6:]
    payload = json.loads(got[1]["payload"])
    assert payload["viewport"]["scrollY"] == 0 and list(payload) == sorted(payload) and list(payload["elements"]) == ["x", 'y"']


def test_auth_specs(spark):
    df = spark.createDataFrame([("anonymous",), ("authenticated:bob",), ("custom-role:editor:ann:s1",), ("administrator",), ("x:y",)], "s string").select("s", state.parse_auth("s").alias("a"))
    got = {r["s"]: r["a"] for r in df.collect()}
    assert got["custom-role:editor:ann:s1"]["role"] == "editor" and got["authenticated:bob"]["principal"] == "bob" and got["administrator"] is None and got["x:y"] is None


def test_targets_and_cookies(spark):
    cases = [("https://app.example.com/a/b", "app.example.com/a", True), ("https://app.example.com.evil.io/a", "app.example.com", False), ("https://app.example.com:443/x", "https://app.example.com/", True), ("https://a.example.com/", "https://*.example.com", True),
             ("https://a.example.com.evil.io/", "https://*.example.com", False), ("window one", "one", True), ("anything", "*", True), ("https://app.example.com/ab", "app.example.com/a", False)]
    df = spark.createDataFrame(cases, "t string, p string, ok boolean")
    assert all(r["ok"] == r["got"] for r in df.select("ok", govern.target_matches("t", F.array("p")).alias("got")).collect())
    assert df.limit(1).select(govern.target_matches("t", F.array().cast("array<string>"))).first()[0] is False
    req = spark.createDataFrame([("o", "sid_1"), ("o", "x"), ("z", "sid_1")], "origin string, cookie string")
    grants = spark.createDataFrame([("o", "sid_*", 100, False)], "origin string, cookie_pattern string, expires_at long, revoked boolean")
    assert sorted((r["origin"], r["cookie"]) for r in govern.cookies_granted(req, grants, 50).where("granted").collect()) == [("o", "sid_1")]
    assert govern.cookies_granted(req, grants, 200).where("granted").count() == 0


def test_audit_chain_notices_changes(spark):
    ev = spark.createDataFrame([("s", i, f"e{i}") for i in range(5)], "stream_id string, seq long, body string")
    chain = govern.audit_chain(ev)
    assert govern.broken_links(chain).count() == 0
    assert govern.broken_links(chain.where("sequence <> 3")).count() == 1
    bots = spark.createDataFrame([("a", "User-agent: *\nDisallow: / # all"), ("b", "User-agent: x\nDisallow: /\nUser-agent: *\nDisallow: /p"), ("c", None)], "key string, body string")
    assert {r["key"]: r["disallow_all"] for r in govern.robots(bots).collect()} == {"a": True, "b": False, "c": False}


def test_page_of_ax():
    assert page_of_ax("ax:page:http://x:80/a:btn") == "page:http://x:80/a" and page_of_ax("nope") is None


def test_alignment_and_tethers(spark):
    rows = [("p", "a1", None, (0.0, 0.0, 10.0, 10.0), {"position": "relative", "anchor-name": "--m"}, 0), ("p", "a2", "a1", (0.0, 50.0, 10.0, 10.0), {}, 1), ("p", "a3", "a2", (0.0, 20.0, 10.0, 10.0), {"position": "absolute", "position-anchor": "--m, --no"}, 2)]
    df = spark.createDataFrame(rows, "page_id string, ax_id string, parent_ax_id string, rect struct<x:double,y:double,w:double,h:double>, style map<string,string>, seq long")
    got = {r["ax_id"]: r for r in layout.tethers(df).collect()}
    assert got["a3"]["parent"] == "a1" and got["a1"]["children"] == ["a2", "a3"] and got["a2"]["siblings_before"] == ["a3"] and got["a3"]["anchors"][0]["target"] == "a1" and len(got["a3"]["anchors"]) == 1


def test_visual_nodes_of_trees_and_declared_tools(spark):
    mac = {"role": "AXWindow", "title": "W", "frame": {"x": 0, "y": 0, "w": 100, "h": 50}, "children": [{"role": "AXButton", "title": "Close", "frame": {"x": 80, "y": 5, "w": 10, "h": 10}}]}
    found = trees.trees(spark.createDataFrame([("p", "u", json.dumps(mac))], "page_id string, url string, tree string"), "macos")
    rows = trees.visual_nodes(found).orderBy("seq").collect()
    assert [(r["rect"]["x"], r["style"]["position"]) for r in rows] == [(0.0, "absolute"), (80.0, "static")] and rows[1]["parent"] == rows[0]["id"]
    from surfacegraph.operators import patterns

    got = {r["id"]: r["primary_pattern"] for r in patterns.patterns(trees.visual_nodes(found)).collect()}
    assert got[rows[1]["id"]] == "dismiss-button" and got[rows[0]["id"]] == "dialog-overlay"
    tools = spark.createDataFrame([("p", "delete_all", None, '{"a": 1}', None, None, None, None, 0), ("p", "pay", "d", None, None, "READ", "ax:1", "#x", 1)], "page_id string, name string, description string, input_schema string, output_schema string, security string, ax_id string, selector string, seq long")
    caps = {r["name"]: r for r in html.declared_capabilities(tools).collect()}
    assert caps["pay"]["security"] == "READ" and caps["delete_all"]["binding"]["selector"] == '[data-cap="delete_all"]' and caps["delete_all"]["security"] in ("EXECUTE", "CONFIRM")


def test_query_covers_every_kind(graph):
    assert set(h["select"] for h in select.hits(graph, "any", {}, 100)["hits"]) == {"ax-node", "visual-node", "edge", "capability", "page", "nav-element", "state"}
