"""Graph documents and the Parquet catalog: reading, writing, publishing.

One JSON document is read with an explicit schema and exploded; at rest the
catalog is a folder of Parquet tables. Output is written beside its target and
renamed, so readers never see half a catalog.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

from ..plans import schema
from ..plans.catalog import Catalog, last_wins

VERSION = "1.0.0"
# Names of a document's arrays, and where its field names differ from the snake case of ours.
ARRAYS = {
    "pages": "pages", "axNodes": "ax", "visualNodes": "visual", "navElements": "nav", "edges": "edges", "capabilities": "capabilities",
    "transitions": "transitions", "states": "states", "authContexts": "auth",
}
RENAMED = {"from": "src", "to": "dst", "computedStyle": "style", "designTokenRefs": "refs"}


class SubstrateError(RuntimeError):
    """A catalog that cannot be used; ``code`` says why."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def snake(name: str) -> str:
    return RENAMED.get(name) or re.sub(r"(?<=[a-z0-9])([A-Z])", lambda m: "_" + m[1].lower(), name)


def camel(name: str) -> str:
    back = {v: k for k, v in RENAMED.items()}
    return back.get(name) or re.sub(r"_([a-z])", lambda m: m[1].upper(), name)


#: Maps whose keys are data, not names.
OPEN_MAPS = ("style", "conditional_markers", "aria_states")
#: Style names that keep their hyphens.
HYPHENATED = ("grid-template-columns", "grid-template-rows", "column-gap", "row-gap", "flex-direction", "flex-wrap", "anchor-name", "position-anchor")


def renamed(value: Any, rule, inside: bool = False) -> Any:
    """A JSON value with its field names changed, except in maps whose keys are data."""
    if isinstance(value, dict):
        return {(k if inside else rule(k)): renamed(v, rule, not inside and rule(k) in (*OPEN_MAPS, *map(camel, OPEN_MAPS))) for k, v in value.items()}
    return [renamed(v, rule) for v in value] if isinstance(value, list) else value


def style_keys(style: str | Column) -> Column:
    """A style map with names in camel case; some names and custom properties keep their hyphens."""

    def name(k: Column) -> Column:
        parts = F.split(k, "[-_]")
        big = lambda p: F.when(p.rlike("^[a-z]"), F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))).otherwise(F.concat(F.lit("_"), p))
        joined = F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), big), ""))
        return F.when(k.isin(*HYPHENATED) | F.startswith(k, F.lit("--")), k).otherwise(joined)

    return F.transform_keys(F.col(style) if isinstance(style, str) else style, lambda k, _: name(k))


def iterate_tokens(tree: dict, typed: bool = True, path: str = ""):
    """(path, token) of a token tree, depth first. A leaf has a value (and, if ``typed``, a type); groups' $ keys are skipped."""
    for k, v in (tree or {}).items():
        if k.startswith("$") or not isinstance(v, dict):
            continue
        at = f"{path}.{k}" if path else k
        if "$value" in v and ("$type" in v or not typed):
            yield at, v
        else:
            yield from iterate_tokens(v, typed, at)


def token_rows(tree: dict, typed: bool = True) -> list[tuple]:
    def text(v):
        return v if isinstance(v, str) else json.dumps(v)

    return [(p, text(t["$value"]), type(t["$value"]).__name__, t.get("$type"), t.get("$description"), i) for i, (p, t) in enumerate(iterate_tokens(tree, typed))]


def token_tree(rows: list[dict]) -> dict:
    """The nested tree of tokens (path, value, value_kind, type, description)."""
    root: dict = {}
    for r in rows:
        at = root
        *groups, leaf = r["path"].split(".")
        for g in groups:
            at = at.setdefault(g, {})
        value = r["value"] if r["value_kind"] == "str" else json.loads(r["value"])
        at[leaf] = {"$value": value, "$type": r["type"]} | ({"$description": r["description"]} if r["description"] else {})
    return root


def _in_camel(t: DataType) -> DataType:
    """A type with the field names that documents use."""
    if isinstance(t, StructType):
        return StructType([StructField(camel(f.name), _in_camel(f.dataType)) for f in t.fields])
    return ArrayType(_in_camel(t.elementType)) if isinstance(t, ArrayType) else t


def _rows_of(name: str) -> StructType:
    return StructType.fromDDL(schema.TABLES[name])


#: What a document says in other places than our columns, by table: (field, type).
_NESTED = {
    "visual": "scrollClippingContext struct<isScrollContainer:boolean>, stackingContext struct<isStackingContext:boolean,zIndex:string>, renderBounds struct<hasTransform:boolean>, "
    f"boxModel struct<boxSizing:string,paddingBox:{schema.RECT}>, designTokenBindings array<struct<tokenPath:string>>, tokenDrifts array<struct<severity:string>>, "
    f"viewportObservations map<string,struct<viewport:{schema.VIEWPORT},rect:{schema.RECT},computedStyle:map<string,string>,visibility:string,crawledAt:string>>",
    "states": "payload struct<route:string,viewport:struct<w:double,h:double,dpr:double,scrollX:double,scrollY:double>,focusedAxId:string,openDialogIds:array<string>,openPopoverIds:array<string>,"
    f"expandedRegionAxIds:array<string>,conditionalMarkers:map<string,string>,elements:map<string,struct<rect:{schema.RECT},visibility:string,zIndex:double,open:boolean,expanded:boolean,"
    "selected:boolean,checked:boolean,pressed:boolean,busy:boolean,focused:boolean,ariaStates:map<string,string>,visualNodeId:string>>>, "
    "authContext struct<kind:string,role:string,principal:string,session:string>, networkContext struct<status:string,evidence:string>, "
    "evidence array<struct<kind:string,sourceAxId:string,transitionId:string,at:string>>",
    "auth": "context struct<kind:string,role:string,principal:string,session:string>",
}
_PROBLEM = "array<struct<pageId:string,url:string,extractor:string,error:string,message:string,at:string,timestamp:string>>"
_PROBLEMS = ("extractorFailures", "pageErrors", "extractionWarnings")


def _wire(name: str) -> StructType:
    """The type of a table's rows in a document."""
    own = [f for f in _in_camel(_rows_of(name)).fields if f.name != "seq"]
    more = StructType.fromDDL(_NESTED[name]).fields if name in _NESTED else []
    taken = {f.name for f in more}
    return StructType([f for f in own if f.name not in taken] + list(more))


def _seq(pos: str) -> Column:
    """The place of a piece's entry among those of all documents."""
    return F.col("doc") * (1 << 32) + F.col("start") + F.col(pos)


def _exploded(docs: DataFrame, key: str, name: str) -> DataFrame:
    """(doc, seq, r): rows of one of the documents' arrays, in the documents' names."""
    whole = F.from_json("text", StructType([StructField(key, ArrayType(_wire(name)))]))[key]
    rows = docs.select("doc", "start", F.posexplode(whole).alias("pos", "r"))
    return rows.select("doc", _seq("pos").alias("seq"), "r")


def _table(rows: DataFrame, name: str, **columns: Column) -> DataFrame:
    """Rows of ``_exploded`` as a table; ``columns`` replaces those that documents say elsewhere."""
    wire = {f.name for f in rows.schema["r"].dataType.fields}
    out = []
    for f in _rows_of(name).fields:
        if f.name == "seq":
            out.append(F.col("seq"))
        elif f.name in columns:
            out.append(columns[f.name].cast(f.dataType).alias(f.name))
        elif camel(f.name) in wire:
            out.append(F.col("r")[camel(f.name)].cast(f.dataType).alias(f.name))
        else:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
    return rows.select("doc", *out)


def _tethered(visual: DataFrame) -> DataFrame:
    """Tethers that name visual nodes, whether they arrive as such or as elements."""
    known = visual.groupBy("doc", F.col("ax_id").alias("ref")).agg(F.min_by("id", "seq").alias("named"))
    t, parts = F.col("tethers"), ("children", "siblings_before", "siblings_after")
    none = F.array().cast("array<struct<part:string,pos:int,ref:string>>")

    def refs_of(p: str) -> Column:
        return F.transform(t[p], lambda ref, i: F.struct(F.lit(p).alias("part"), i.alias("pos"), ref.alias("ref")))

    listed = [refs_of(p) for p in parts]
    listed += [F.when(t["parent"].isNotNull(), F.array(F.struct(F.lit("parent").alias("part"), F.lit(0).alias("pos"), t["parent"].alias("ref"))))]
    refs = visual.select("doc", "seq", F.explode(F.flatten(F.array(*[F.coalesce(c, none) for c in listed]))).alias("x")).select("doc", "seq", "x.*")
    found = refs.join(known, ["doc", "ref"], "left").withColumn("ref", F.coalesce("named", "ref"))
    of = lambda p: F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct("pos", "ref")))), lambda x: x["ref"])
    fixed = found.groupBy("doc", "seq").agg(F.max(F.when(F.col("part") == "parent", F.col("ref"))).alias("_parent"), *[of(p).alias(f"_{p}") for p in parts])
    empty = F.array().cast("array<string>")
    whole = F.struct(F.col("_parent").alias("parent"), *[F.coalesce(f"_{p}", empty).alias(p) for p in parts], t["anchors"].alias("anchors"))
    return visual.join(fixed, ["doc", "seq"], "left").withColumn("tethers", whole).drop("_parent", *[f"_{p}" for p in parts])


def _tokens(docs: DataFrame) -> DataFrame:
    """Tokens of the documents' trees, which have no fixed depth."""
    import pyarrow as pa

    wire = pa.schema([("path", pa.string()), ("value", pa.string()), ("value_kind", pa.string()), ("type", pa.string()), ("description", pa.string()), ("seq", pa.int64())])

    def run(batches):
        for b in batches:
            for first, tree in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = token_rows(json.loads(tree)) if tree else []
                yield pa.RecordBatch.from_pylist([dict(zip(wire.names, (*r[:-1], first + r[-1]), strict=True)) for r in rows], schema=wire)

    return docs.withColumn("pos", F.lit(0)).select(_seq("pos").alias("first"), F.get_json_object("text", "$.designTokens").alias("tree")).mapInArrow(run, schema.TABLES["tokens"])


def from_documents(docs: DataFrame) -> Catalog:
    """The catalog of graph documents ``docs(doc long, text string)``, a document a row, in the order of ``doc``.

    Documents are parsed where they lie, an array at a time, with explicit
    types: missing fields are null, missing arrays empty, extra ones ignored.
    Later rows of an id replace earlier ones. A document of another version,
    or one that is no JSON, is refused.

    A document too large for a row comes in pieces, each a document with some of
    the entries of its arrays: ``docs(doc, start, text)``, where ``start`` is the
    place of a piece's first entries. What is no array is in the piece at 0.
    """
    spark = docs.sparkSession
    docs = docs if "start" in docs.columns else docs.withColumn("start", F.lit(0).cast("long"))
    bad = docs.select(F.from_json("text", "version string")["version"].alias("v")).where(~F.col("v").eqNullSafe(F.lit(VERSION))).first()
    if bad is not None:
        raise SubstrateError("SUBSTRATE_INVALID", f"version {bad['v']!r} is not {VERSION}")
    raw = {name: _exploded(docs, key, name) for key, name in ARRAYS.items()}
    tables = {name: _table(raw[name], name) for name in ("pages", "ax", "nav", "edges", "capabilities", "transitions")}

    r = F.col("r")
    box, stack, seen = r["boxModel"], r["stackingContext"], r["viewportObservations"]
    visual = _table(
        raw["visual"], "visual", style=style_keys(r["computedStyle"]), is_scroll_container=r["scrollClippingContext"]["isScrollContainer"], is_stacking_context=stack["isStackingContext"],
        z_index=stack["zIndex"].try_cast("int"), has_transform=r["renderBounds"]["hasTransform"], box_sizing=box["boxSizing"], padding_box=box["paddingBox"],
        bindings=F.transform(r["designTokenBindings"], lambda b: b["tokenPath"]), drift_severities=F.transform(r["tokenDrifts"], lambda d: d["severity"]),
    )
    tables["visual"] = _tethered(visual)
    o = F.col("o")
    views = raw["visual"].select("seq", r["axId"].alias("ax_id"), F.explode(seen).alias("vp_key", "o"))
    tables["observations"] = views.select("ax_id", "vp_key", o["viewport"].alias("viewport"), o["rect"].alias("rect"), style_keys(o["computedStyle"]).alias("style"), o["visibility"].alias("visibility"), o["crawledAt"].alias("crawled_at"), "seq")

    said = r["payload"]
    own = {c: said[camel(c)] for c in ("route", "viewport", "focused_ax_id", "open_dialog_ids", "open_popover_ids", "expanded_region_ax_ids", "conditional_markers")}
    auth, net = r["authContext"], r["networkContext"]
    own |= {"auth_kind": auth["kind"], "auth_role": auth["role"], "principal": auth["principal"], "session": auth["session"], "network_status": net["status"], "network_evidence": net["evidence"]}
    tables["states"] = _table(raw["states"], "states", **own)
    elements = raw["states"].select(r["id"].alias("state_id"), F.explode(said["elements"]).alias("ax_id", "e"))
    fields = [f for f in _rows_of("state_elements").fields if f.name not in ("state_id", "ax_id")]
    tables["state_elements"] = elements.select("state_id", "ax_id", *[F.col("e")[camel(f.name)].cast(f.dataType).alias(f.name) for f in fields])
    pieces = raw["states"].select(r["id"].alias("state_id"), F.posexplode(r["evidence"]).alias("pos", "e"))
    tables["state_evidence"] = pieces.select("state_id", "e.kind", F.col("e.sourceAxId").alias("source_ax_id"), F.col("e.transitionId").alias("transition_id"), "e.at", F.col("pos").cast("long").alias("seq"))
    tables["auth"] = _table(raw["auth"], "auth", **{k: F.coalesce(r["context"][k], r[k]) for k in ("kind", "role", "principal", "session")})
    for name in ARRAYS.values():
        tables[name] = last_wins(tables[name].drop("doc"))

    tables["tokens"] = _tokens(docs)
    problems = docs.select("doc", "start", F.from_json("text", f"diagnostics struct<{', '.join(f'{k}:{_PROBLEM}' for k in _PROBLEMS)}>")["diagnostics"].alias("d"))
    d, found = F.col("d"), None
    for kind in _PROBLEMS:
        rows = problems.select("doc", "start", F.posexplode(d[kind]).alias("pos", "e")).select(
            F.lit(kind).alias("kind"), F.col("e.pageId").alias("page_id"), "e.url", F.col("e.extractor").alias("source"), F.coalesce("e.error", "e.message").alias("message"), F.coalesce("e.at", "e.timestamp").alias("at"),
            _seq("pos").alias("seq"),
        )
        found = rows if found is None else found.unionByName(rows)
    tables["diagnostics"] = found
    crawl = docs.where("start = 0").select(F.from_json("text", "crawl struct<rootUrl:string,startedAt:string>")["crawl"].alias("c"))
    meta = {"version": F.lit(VERSION), "root_url": F.col("c.rootUrl"), "started_at": F.col("c.startedAt"), "complete": F.lit(True)}
    tables["meta"] = crawl.select(*[meta.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in _rows_of("meta").fields])
    return Catalog(spark, tables)


def from_document(spark: SparkSession, doc: dict) -> Catalog:
    """The catalog of one graph document that the driver holds."""
    return from_documents(spark.createDataFrame([(0, json.dumps(doc))], "doc long, text string"))


def read_document(spark: SparkSession, path: str) -> Catalog:
    """The catalog of a graph document file, or of all in a folder, which the executors read."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"))
    # documents are few and their order is that of the file names
    names = sorted(x["file"] for x in files.select("file").collect())
    order = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "file string, doc long")
    return from_documents(files.join(order, "file").select("doc", "text"))


def to_document(catalog: Catalog) -> dict:
    """The graph document of a catalog, for catalogs that a driver can hold."""
    doc: dict[str, Any] = {"version": VERSION, "designTokens": token_tree([r.asDict() for r in catalog.tokens.orderBy("seq").collect()])}
    for key, name in ARRAYS.items():
        rows = getattr(catalog, name).orderBy("seq").toJSON().collect()
        doc[key] = [{k: v for k, v in renamed(json.loads(r), camel).items() if k != "seq"} for r in rows]
    return doc


def wire_rows(catalog: Catalog, name: str) -> DataFrame:
    """(seq, raw): rows of a table as a document has them, in JSON.

    Nested things that a document keeps elsewhere (states' payloads, contexts)
    are put back where :func:`from_documents` finds them.
    """
    df = getattr(catalog, name)
    rows, own = df, [f.name for f in _rows_of(name).fields if f.name != "seq" and f.name in df.columns]
    extra = []
    if name == "visual":
        z = F.col("z_index").cast("string") if "z_index" in own else F.lit(None).cast("string")
        pick = lambda c, kind: (F.col(c) if c in own else F.lit(None)).cast(kind)
        extra = [
            F.struct(pick("is_scroll_container", "boolean").alias("isScrollContainer")).alias("scrollClippingContext"), F.struct(pick("is_stacking_context", "boolean").alias("isStackingContext"), z.alias("zIndex")).alias("stackingContext"),
            F.struct(pick("has_transform", "boolean").alias("hasTransform")).alias("renderBounds"), F.struct(pick("box_sizing", "string").alias("boxSizing"), pick("padding_box", schema.RECT).alias("paddingBox")).alias("boxModel"),
            F.transform(pick("bindings", "array<string>"), lambda b: F.struct(b.alias("tokenPath"))).alias("designTokenBindings"), F.transform(pick("drift_severities", "array<string>"), lambda d: F.struct(d.alias("severity"))).alias("tokenDrifts"),
        ]
    if name == "states":
        said = ("route", "viewport", "focused_ax_id", "open_dialog_ids", "open_popover_ids", "expanded_region_ax_ids", "conditional_markers")
        types = {f.name: f.dataType for f in _rows_of(name).fields}
        extra = [
            F.struct(*[F.col(c).cast(_in_camel(types[c])).alias(camel(c)) for c in said if c in own]).alias("payload"),
            F.struct(*[F.col(c).alias(k) for k, c in (("kind", "auth_kind"), ("role", "auth_role"), ("principal", "principal"), ("session", "session")) if c in own]).alias("authContext"),
            F.struct(*[F.col(c).alias(k) for k, c in (("status", "network_status"), ("evidence", "network_evidence")) if c in own]).alias("networkContext"),
        ]
    types = {f.name: f.dataType for f in _rows_of(name).fields}
    plain = [F.col(c).cast(_in_camel(types[c])).alias(camel(c)) for c in own]
    return rows.select("seq", F.to_json(F.struct(*plain, *extra)).alias("raw"))


#: Columns that tables are clustered by on disk, so that filters skip row groups.
CLUSTERED = {"ax": ("page_id", "role"), "visual": ("page_id", "ax_id"), "edges": ("kind", "src"), "observations": ("ax_id", "vp_key"), "states": ("page_id", "id"), "capabilities": ("page_id", "name")}


def hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop(spark, path)
    return fs.exists(p)


def save(catalog: Catalog, path: str, overwrite: bool = False, idempotency_key: str | None = None) -> None:
    """Writes all tables beside ``path`` and renames the folder. An existing catalog is refused unless ``overwrite``."""
    spark = catalog.spark
    if exists(spark, path) and not overwrite:
        raise SubstrateError("SUBSTRATE_EXISTS", path)
    staging = f"{path}.partial-{idempotency_key or uuid.uuid4().hex}"
    for name in schema.TABLES:
        df = getattr(catalog, name)
        if name in CLUSTERED:
            df = df.sortWithinPartitions(*CLUSTERED[name])
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy("kind") if name == "edges" else writer).parquet(f"{staging}/{name}")
    fs, target = hadoop(spark, path)
    old = hadoop(spark, f"{path}.replaced-{uuid.uuid4().hex}")[1]
    # the old catalog stays whole until the new one is in place
    replaced = fs.exists(target) and fs.rename(target, old)
    if not fs.rename(hadoop(spark, staging)[1], target):
        if replaced:
            fs.rename(old, target)
        raise SubstrateError("SUBSTRATE_IO", f"cannot rename {staging}")
    if replaced:
        fs.delete(old, True)


def load(spark: SparkSession, path: str, need_complete: bool = True) -> Catalog:
    """The catalog in a folder; a missing one, or one marked incomplete, is refused."""
    if not exists(spark, f"{path}/pages"):
        raise SubstrateError("SUBSTRATE_MISSING", path)
    tables = {name: spark.read.schema(schema.TABLES[name]).parquet(f"{path}/{name}") for name in schema.TABLES}
    meta = tables["meta"].first()
    if need_complete and meta is not None and meta["complete"] is False:
        raise SubstrateError("SUBSTRATE_INCOMPLETE", path)
    return Catalog(spark, tables)


def job_key(root: str, scope: str, max_pages: int, out: str) -> str:
    """The key by which equal crawl jobs are one job."""
    return hashlib.sha256(f"{root}|{scope}|{max_pages}|{out}".encode()).hexdigest()[:16]


def frontier_hash(urls: DataFrame, column: str = "url") -> DataFrame:
    """(frontier_hash): sha256 of the sorted URLs, a line each.

    The hash is of one text by definition, so the URLs of one crawl meet in one task.
    """
    return urls.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(column)), "\n"), 256).alias("frontier_hash"))


def bind(catalog: Catalog, graph_hash: str, expected: str | None) -> Catalog:
    """The catalog, if its hash is the expected one."""
    if expected is not None and graph_hash != expected:
        raise SubstrateError("SUBSTRATE_BINDING", f"{graph_hash} is not {expected}")
    return catalog


def append_log(df: DataFrame, path: str) -> None:
    """Appends rows as JSON lines."""
    df.write.mode("append").json(path)


def auth_state(spark: SparkSession, path: str, version: str = VERSION) -> dict:
    """A session file's content; another version is refused."""
    doc = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if doc.get("version") != version:
        raise SubstrateError("AUTH_STATE_VERSION", str(doc.get("version")))
    return doc


def write_trace(rows: DataFrame, path: str) -> None:
    """Writes evaluation results as one JSON lines file."""
    rows.coalesce(1).write.mode("overwrite").json(path)
