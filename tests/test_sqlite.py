"""SQLite files pass neither through the driver nor through a result."""

import json
import sqlite3

from surfacegraph import catalogue_capture
from surfacegraph.plans.catalog import Catalog
from surfacegraph.sources import sqlite


def test_a_file_larger_than_results_may_be_is_saved_and_replaced(spark, tmp_path):
    ax = spark.range(400).selectExpr("concat('ax:', id) as id", "repeat(hex(id * 7919), 200) as name", "id as seq")
    path = f"file://{tmp_path}/c.db"
    sent = []
    run = sqlite.hadoop
    sqlite.hadoop = lambda s, p: (type("F", (), {"__getattr__": lambda _, n: (sent.append(n), getattr(run(s, p)[0], n))[1]})(), run(s, p)[1])
    try:
        sqlite.save(Catalog(spark, {"ax": ax.where("seq < 300")}), path)
        sqlite.save(Catalog(spark, {"ax": ax.where("seq >= 200")}), path)
    finally:
        sqlite.hadoop = run
    assert "create" not in sent and "rename" in sent  # the driver writes no content
    con = sqlite3.connect(f"{tmp_path}/c.db")
    assert con.execute("SELECT count(*), count(DISTINCT id) FROM ax_nodes").fetchall() == [(400, 400)]
    assert con.execute("PRAGMA integrity_check").fetchall() == [("ok",)]
    assert [p.name for p in tmp_path.iterdir() if p.suffix != ".crc"] == ["c.db"]
    assert sqlite.load(spark, path).ax.count() == 400


def test_lists_of_documents_are_not_sent_to_every_task(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(catalogue_capture, "cut", lambda df: (plans.append(df._jdf.queryExecution().sparkPlan().toString()), df)[1])
    catalogue_capture.documents(spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin" not in plans[0] and "SortMergeJoin" in plans[0]


def test_a_file_is_read_in_pieces_of_the_same_document(spark, tmp_path, monkeypatch):
    """However many rows a file has, no row of its document holds more than some of them, in their order."""
    ax = spark.range(450).selectExpr("concat('ax:', lpad(id, 4, '0')) as id", "concat('n', id) as name", "id as seq", "449 - id as in_page_dom_order")
    auth = spark.range(7).selectExpr("concat('auth:', id) as id", "'r' as role", "id as seq")
    path = f"file://{tmp_path}/c.db"
    sqlite.save(Catalog(spark, {"ax": ax, "auth": auth}), path)
    monkeypatch.setattr(sqlite, "PIECE", 100)
    texts, run = [], sqlite.from_documents
    monkeypatch.setattr(sqlite, "from_documents", lambda docs: (texts.extend(docs.orderBy("start").collect()), run(docs))[1])
    back = sqlite.load(spark, path)
    assert [len(json.loads(r["text"]).get("axNodes", [])) for r in texts] == [100, 100, 100, 100, 50]
    assert [r["id"] for r in back.ax.orderBy("seq").collect()] == [f"ax:{449 - i:04}" for i in range(450)]
    assert back.auth.count() == 7 and back.meta.count() == 1
