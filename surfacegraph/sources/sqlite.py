"""Catalogs in a SQLite file: a table a node kind, each row with its JSON.

A SQLite file is one file by nature: one task reads or writes it, and the rest
goes by way of graph documents. Many files are read by as many tasks. A file is
written and read on the task's disk and copied from and to there in pieces, and
its document comes in pieces too, so it passes neither through the driver nor
whole through memory.
"""

from __future__ import annotations

import json
import os
import shutil
import sqlite3
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import Catalog
from ..plans.lineage import cut
from .graph_json import ARRAYS, VERSION, SubstrateError, exists, from_documents, hadoop, wire_rows

# The file's tables, by array of a document, and the order in which rows are read.
TABLES = {
    "pages": ("pages", "id"), "axNodes": ("ax_nodes", "in_page_dom_order"), "visualNodes": ("visual_nodes", "id"), "navElements": ("nav_elements", "id"), "edges": ("edges", "id"),
    "capabilities": ("capability_nodes", "id"), "transitions": ("transitions", "id"), "states": ("state_nodes", "id"), "authContexts": ("auth_context_nodes", "id"),
}
#: Columns beside the JSON: (name, type, field of the JSON that fills it).
COLUMNS = {
    "pages": (("id", "TEXT PRIMARY KEY", "id"), ("url", "TEXT", "url"), ("canonical_url", "TEXT", "canonicalUrl"), ("title", "TEXT", "title"), ("load_status", "TEXT", "loadStatus")),
    "ax_nodes": (("id", "TEXT PRIMARY KEY", "id"), ("page_id", "TEXT", "pageId"), ("role", "TEXT", "role"), ("name", "TEXT", "name"), ("in_page_dom_order", "INTEGER", "inPageDomOrder")),
    "visual_nodes": (("id", "TEXT PRIMARY KEY", "id"), ("page_id", "TEXT", "pageId"), ("ax_id", "TEXT", "axId")),
    "nav_elements": (("id", "TEXT PRIMARY KEY", "id"), ("page_id", "TEXT", "pageId"), ("kind", "TEXT", "kind"), ("container_ax_id", "TEXT", "containerAxId")),
    "edges": (("id", "INTEGER PRIMARY KEY AUTOINCREMENT", None), ("from_id", "TEXT", "from"), ("to_id", "TEXT", "to"), ("kind", "TEXT", "kind")),
    "capability_nodes": (("id", "TEXT PRIMARY KEY", "id"), ("page_id", "TEXT", "pageId"), ("name", "TEXT", "name"), ("security", "TEXT", "security")),
    "transitions": (("id", "TEXT PRIMARY KEY", "id"), ("kind", "TEXT", "kind"), ("trigger", "TEXT", "trigger"), ("from_ax_id", "TEXT", "fromAxId")),
    "state_nodes": (("id", "TEXT PRIMARY KEY", "id"), ("page_id", "TEXT", "pageId")),
    "auth_context_nodes": (("id", "TEXT PRIMARY KEY", "id"), ("kind", "TEXT", "kind")),
}
#: Tables that a save replaces whole; of the others it replaces rows of the same id.
REPLACED = ("edges",)


#: Rows of a table that one piece of a file's document has.
PIECE = 1000


def _pieces(path: str, size: int) -> Iterator[tuple[int, str]]:
    """(start, text): a file's graph document, in pieces of up to ``size`` rows of each table."""
    con = sqlite3.connect(path)
    try:
        there = {n for (n,) in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
        rows = {key: con.execute(f"SELECT raw_json FROM {table} ORDER BY {order}") for key, (table, order) in TABLES.items() if table in there}
        parts, start = [], 0
        if "design_tokens" in there:
            tree: dict = {}
            for name, raw in con.execute("SELECT path, raw_json FROM design_tokens ORDER BY path"):
                at = tree
                *groups, last = name.split(".")
                for g in groups:
                    at = at.setdefault(g, {})
                at[last] = json.loads(raw)
            parts.append(f'"designTokens": {json.dumps(tree)}')
        if "crawl_meta" in there:
            for root, started, diagnostics in con.execute("SELECT root_url, started_at, diagnostics_json FROM crawl_meta"):
                parts.append('"crawl": ' + json.dumps({"rootUrl": root, "startedAt": started}))
                parts += [f'"diagnostics": {diagnostics}'] if diagnostics else []
        while True:
            some = {key: r.fetchmany(size) for key, r in rows.items()}
            parts += [f'"{key}": [' + ", ".join(raw for (raw,) in r) + "]" for key, r in some.items() if r]
            if start and not parts:
                return
            yield start, "{" + ", ".join([f'"version": "{VERSION}"', *parts]) + "}"
            parts, start = [], start + size
    except sqlite3.DatabaseError as e:
        raise SubstrateError("SUBSTRATE_INVALID", str(e)) from e
    finally:
        con.close()


def _file_system(uri: str):
    """(pyarrow file system, path) of a URI; a bare path is local."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _opens(uri: str) -> bool:
    """Tasks can read it in pieces; what only Spark's readers open comes to them whole."""
    try:
        return bool(_file_system(uri))
    except (pa.ArrowException, OSError):
        return False


def load(spark: SparkSession, path: str) -> Catalog:
    """The catalog of a SQLite file, or of all in a folder, one after another by name."""
    if not exists(spark, path):
        raise SubstrateError("SUBSTRATE_MISSING", path)
    files = spark.read.format("binaryFile").load(path)
    names = sorted(r["path"] for r in files.select("path").collect())  # a row a file
    order = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "path string, doc long")
    size, content = PIECE, F.lit(None).cast("binary") if all(map(_opens, names)) else F.col("content")

    def run(batches):
        for b in batches:
            for doc, name, whole in zip(*(b.column(k).to_pylist() for k in ("doc", "path", "whole")), strict=True):
                with tempfile.TemporaryDirectory() as folder:
                    own = os.path.join(folder, "catalog.db")
                    with open(own, "wb") as out:
                        if whole is None:
                            system, at = _file_system(name)
                            with system.open_input_stream(at, compression=None) as source:
                                shutil.copyfileobj(source, out, 1 << 22)
                        else:
                            out.write(whole)
                    for start, text in _pieces(own, size):
                        yield pa.RecordBatch.from_pydict({"doc": [doc], "start": [start], "text": [text]})

    docs = files.join(order, "path").select("doc", "path", content.alias("whole")).mapInArrow(run, "doc long, start long, text string")
    # files are read once, and what was one file is parsed by many tasks
    return from_documents(cut(docs.repartition("doc", "start")))


def _insert(con: sqlite3.Connection, table: str, raw: str) -> None:
    row, columns = json.loads(raw), COLUMNS[table]
    own = [(c, row.get(field)) for c, _, field in columns if field]
    names = ", ".join([*(c for c, _ in own), "raw_json"])
    con.execute(f"INSERT OR REPLACE INTO {table} ({names}) VALUES ({', '.join('?' * (len(own) + 1))})", [*(v for _, v in own), raw])


def save(catalog: Catalog, path: str) -> None:
    """Writes the catalog into a SQLite file, beside its target and then in its place.

    Rows of a known id are replaced, others of an existing file stay; edges and
    tokens are replaced whole. The file goes through one task, in order.
    """
    spark = catalog.spark
    rows: DataFrame | None = None
    for rank, (key, (table, _)) in enumerate(TABLES.items()):
        one = wire_rows(catalog, ARRAYS[key]).select(F.lit(rank).alias("rank"), F.lit(table).alias("name"), "seq", "raw")
        rows = one if rows is None else rows.unionByName(one)
    leaf = F.to_json(F.struct(F.col("value").alias("$value"), F.col("type").alias("$type")))
    rows = rows.unionByName(catalog.tokens.select(F.lit(len(TABLES)).alias("rank"), F.concat(F.lit("token:"), "path").alias("name"), "seq", leaf.alias("raw")))
    there, meta = exists(spark, path), catalog.meta.first()
    staged = f"{path}.partial-{uuid.uuid4().hex}"

    def fill(con: sqlite3.Connection, batches) -> None:
        for table, columns in COLUMNS.items():
            con.execute(f"CREATE TABLE IF NOT EXISTS {table} ({', '.join(f'{c} {t}' for c, t, _ in columns)}, raw_json TEXT NOT NULL)")
        con.execute("CREATE TABLE IF NOT EXISTS design_tokens (path TEXT PRIMARY KEY, raw_json TEXT NOT NULL)")
        con.execute("CREATE TABLE IF NOT EXISTS crawl_meta (id INTEGER PRIMARY KEY, started_at TEXT, root_url TEXT, diagnostics_json TEXT)")
        for table in (*REPLACED, "design_tokens"):
            con.execute(f"DELETE FROM {table}")
        if meta is not None:
            con.execute("INSERT OR REPLACE INTO crawl_meta VALUES (1, ?, ?, NULL)", [meta["started_at"], meta["root_url"]])
        for b in batches:
            for name, raw in zip(b.column("name").to_pylist(), b.column("raw").to_pylist(), strict=True):
                if name.startswith("token:"):
                    con.execute("INSERT OR REPLACE INTO design_tokens VALUES (?, ?)", [name[6:], raw])
                else:
                    _insert(con, name, raw)
        con.commit()

    def run(batches):
        with tempfile.TemporaryDirectory() as folder:
            own = os.path.join(folder, "catalog.db")
            if there:
                system, at = _file_system(path)
                with system.open_input_stream(at, compression=None) as source, open(own, "wb") as out:
                    shutil.copyfileobj(source, out, 1 << 22)
            con = sqlite3.connect(own)
            try:
                con.execute("PRAGMA journal_mode = OFF")  # the file is this task's until it is whole
                con.execute("PRAGMA synchronous = OFF")
                fill(con, batches)
            finally:
                con.close()
            system, at = _file_system(staged)
            with open(own, "rb") as source, system.open_output_stream(at, compression=None) as out:
                shutil.copyfileobj(source, out, 1 << 22)
            yield pa.RecordBatch.from_pydict({"bytes": [os.path.getsize(own)]}, schema=pa.schema([("bytes", pa.int64())]))

    ordered = rows.repartition(1).sortWithinPartitions("rank", "seq")  # one file
    ordered.mapInArrow(run, "bytes long").collect()  # a row
    (fs, target), made = hadoop(spark, path), hadoop(spark, staged)[1]
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(made, target):
        raise SubstrateError("SUBSTRATE_IO", f"cannot rename {staged}")
