"""Requests by name: the tool and method names of a graph server, answered from a catalog.

``dispatch`` takes a method and its parameters and returns a JSON-ready answer
or an error with a JSON-RPC code. Answers are bounded by the request's limit.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import govern, occlusion, patterns, regression, report, select, spatial, tokens, traverse, viewport
from .plans.catalog import Catalog
from .sources import graph_json

# JSON-RPC error codes.
PARSE, INVALID_REQUEST, NO_METHOD, BAD_PARAMS, INTERNAL, DENIED, NOT_FOUND = -32700, -32600, -32601, -32602, -32603, -32003, -32004


class ApiError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def rows(df: DataFrame, limit: int = select.MOST_ROWS) -> list[dict]:
    return [json.loads(r) for r in df.limit(limit).toJSON().collect()]


def _need(params: dict, *names: str) -> list:
    missing = [n for n in names if params.get(n) is None]
    if missing:
        raise ApiError(BAD_PARAMS, f"missing: {', '.join(missing)}")
    return [params[n] for n in names]


def _query(c: Catalog, p: dict) -> dict:
    kind = p.get("select", "any")
    if kind != "any" and kind not in select.KINDS:
        raise ApiError(BAD_PARAMS, f"unknown kind: {kind}")
    return select.hits(c, kind, p.get("where"), int(p.get("limit", select.DEFAULT_LIMIT)))


def _path(c: Catalog, p: dict) -> Any:
    start, end, relation = p.get("from"), p.get("to", p.get("target")), p.get("relation", "path")
    if start is None:
        raise ApiError(BAD_PARAMS, "missing: from")
    got = traverse.relate(c, start, relation, end, p.get("depth", 5), int(p.get("maxHops", 5)), p.get("via"))
    return got if isinstance(got, dict) else {"nodes": rows(got)}


def _explain(c: Catalog, p: dict) -> dict:
    (node,) = _need(p, "id")
    if c.get("ax", node).isEmpty():
        raise ApiError(NOT_FOUND, f"no element {node}")
    return {k: rows(v) for k, v in traverse.explain(c, node, int(p.get("depth", 2))).items()}


def _act(c: Catalog, p: dict) -> dict:
    (cap,) = _need(p, "capabilityId")
    found = rows(govern.prepare_act(c.get("capabilities", cap), c.ax, bool(p.get("confirm"))), 1)
    if not found:
        raise ApiError(NOT_FOUND, f"no capability {cap}")
    return found[0]


def _visual(c: Catalog, p: dict) -> dict:
    (ax,) = _need(p, "axId")
    name, width = (p.get("viewport"), None) if isinstance(p.get("viewport"), str) else (None, (p.get("viewport") or {}).get("w"))
    if name is None and width is None:
        found = rows(c.visual_by_ax(ax), 1)
    else:
        one = c.visual.where(F.col("ax_id") == ax).select("ax_id").distinct()
        found = rows(viewport.at_viewport(one, c.observations, c.visual.withColumn("visibility", F.lit("visible")), name, width), 1)
    if not found:
        raise ApiError(NOT_FOUND, f"no visual node of {ax}")
    return found[0]


def _pairs(c: Catalog, p: dict) -> DataFrame:
    start, end = _need(p, "from", "to")
    seen = c.observations.join(c.ax.select(F.col("id").alias("ax_id"), "page_id"), "ax_id")
    at = lambda n: seen.where(F.lower("viewport.name") == n.lower())
    pairs = viewport.pair_up(at(start), at(end))
    for key, column in (("pageId", "page_id"), ("axId", "ax_id")):
        if p.get(key):
            pairs = pairs.where(F.col(column) == p[key])
    return pairs


def _regression(c: Catalog, p: dict) -> dict:
    base: Catalog | None = p.get("baseline")
    side = lambda g: g.primary_visual().select("page_id", "ax_id", "rect", "style", "refs", "primary_pattern", F.col("occlusion.visible_ratio").alias("visible_ratio"), F.col("occlusion.is_occluded").alias("is_occluded"))
    a, b = side(base) if base is not None else side(c).limit(0), side(c)
    if p.get("pageId"):
        a, b = a.where(F.col("page_id") == p["pageId"]), b.where(F.col("page_id") == p["pageId"])
    d = regression.node_differences(a, b)
    return {"report": rows(regression.report(d)), "nodes": rows(d.where(F.size("defects") > 0), int(p.get("limit", 10)))}


def _export(c: Catalog, p: dict) -> dict:
    counts = {r["type"]: r["n"] for r in tokens.export_counts(c.tokens).collect()}
    tree = graph_json.token_tree([r.asDict() for r in c.tokens.orderBy("seq").collect()])
    return {"version": graph_json.VERSION, "tokens": tree, "metadata": {"totalTokens": sum(counts.values()), "tokenTypes": counts}}


def _diagnostics(c: Catalog, p: dict) -> dict:
    bare = [] if p.get("includeUnlabeledInteractive") is False else rows(report.unlabeled(c.ax).orderBy("seq"), 50)
    kinds = {k: rows(c.diagnostics.where(F.col("kind") == k)) for k in ("extractorFailures", "extractionWarnings")}
    return {"summary": rows(report.loading_health(c), 1)[0], "failedPages": rows(report.failed_pages(c)), "unlabeledInteractive": bare} | kinds


def _summary(c: Catalog, p: dict) -> dict:
    return {"counts": {r["kind"]: r["n"] for r in c.counts().collect()}, "edgesByKind": {r["kind"]: r["n"] for r in report.edge_histogram(c.edges).collect()}, "pages": rows(report.page_counts(c)), "states": rows(report.state_rows(c))}


METHODS: dict[str, Callable[[Catalog, dict], Any]] = {
    "graph_query": _query,
    "graph_path": _path,
    "graph_tool": lambda c, p: {"tools": rows(govern.tools(c.capabilities, p.get("pageId"), p.get("name"), p.get("securityAtMost"), c.pages, p.get("pageUrl")))},
    "graph_act": _act,
    "graph_invoke": lambda c, p: _act(c, p) | {"executed": False},
    "graph_explain": _explain,
    "substrate_info": lambda c, p: (rows(c.meta, 1) or [{}])[0],
    "graph_diagnostics": _diagnostics,
    "summary": _summary,
    "inspect": lambda c, p: rows(report.gate(report.penalty_health(c), int(p.get("maxFailures", 0))), 1)[0],
    "get_visual": _visual,
    "get_visual_patterns": lambda c, p: {"nodes": rows(patterns.nodes_with_pattern(c.visual, p.get("pageId"), p.get("pattern"), float(p.get("minConfidence", 0.5))))},
    "get_visual_containers": lambda c, p: {"nodes": rows(c.visual_containers(p.get("pageId")))},
    "get_spatial_neighbors": lambda c, p: {"nodes": rows(spatial.neighbors(c.edges.withColumn("distance", F.col("spatial.distance")), c.visual.drop("seq"), _need(p, "visId")[0], p.get("direction")))},
    "get_occluded_nodes": lambda c, p: {"nodes": rows(occlusion.occluded_nodes(c.visual, p.get("pageId"), float(p.get("minVisibleRatio", 0.5))))},
    "query_viewport_diff": lambda c, p: {"diffs": rows(viewport.summary(viewport.differences(_pairs(c, p))))},
    "query_page_layout_mutations": lambda c, p: {"mutations": rows(viewport.mutations(_pairs(c, p))), "summary": rows(viewport.page_mutations(viewport.mutations(_pairs(c, p))))},
    "query_visual_regression": _regression,
    "lint_design_tokens": lambda c, p: {"drifts": rows(tokens.lint(c.visual, c.tokens, p.get("pageId")))},
    "export_dtcg_tokens": _export,
}
#: Dotted and other names of the methods.
OTHER_NAMES = {
    "graph.query": "graph_query", "graph.path": "graph_path", "graph.tool": "graph_tool", "graph.act": "graph_act", "graph.invoke": "graph_invoke", "graph.explain": "graph_explain",
    "substrate.info": "substrate_info", "diagnostics": "graph_diagnostics", "graph.getVisual": "get_visual", "graph.visualPatterns": "get_visual_patterns", "graph.visualContainers": "get_visual_containers",
    "graph.spatialNeighbors": "get_spatial_neighbors", "graph.occludedNodes": "get_occluded_nodes", "graph.viewportDiff": "query_viewport_diff", "graph.pageLayoutMutations": "query_page_layout_mutations",
    "graph.visualRegression": "query_visual_regression", "graph.lintTokens": "lint_design_tokens", "graph.exportTokens": "export_dtcg_tokens", "query": "graph_query", "diff": "query_visual_regression", "tokens": "lint_design_tokens",
}


def viewer_body(catalog: Catalog, path: str) -> dict:
    """The body that a viewer shows at a path: the graph, its summary, or its meta row."""
    if path == "/graph.json":
        return graph_json.to_document(catalog)
    if path == "/summary.json":
        return _summary(catalog, {})
    if path == "/meta.json":
        return (rows(catalog.meta, 1) or [{}])[0]
    raise ApiError(NO_METHOD, f"unknown path: {path}")


def dispatch(catalog: Catalog, method: str, params: dict | None = None) -> dict:
    """{"result": ...} or {"error": {code, message}}."""
    handler = METHODS.get(OTHER_NAMES.get(method, method))
    if handler is None:
        return {"error": {"code": NO_METHOD, "message": f"unknown method: {method}"}}
    try:
        return {"result": handler(catalog, params or {})}
    except ApiError as e:
        return {"error": {"code": e.code, "message": str(e)}}
    except (KeyError, TypeError, ValueError) as e:
        return {"error": {"code": BAD_PARAMS, "message": str(e)}}


def handle(catalog: Catalog, line: str) -> str:
    """One JSON-RPC request line to one response line."""
    try:
        request = json.loads(line)
    except ValueError as e:
        return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": PARSE, "message": str(e)}})
    if not isinstance(request, dict) or not isinstance(request.get("method"), str):
        return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": INVALID_REQUEST, "message": "a request has a method"}})
    return json.dumps({"jsonrpc": "2.0", "id": request.get("id")} | dispatch(catalog, request["method"], request.get("params")))
