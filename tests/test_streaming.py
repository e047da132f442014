import json

from pyspark.sql import functions as F

from surfacegraph.streaming import live


def put(folder, name, rows):
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_upserts_and_evidence(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "id string, name string, seq long"
    put(src, "a.json", [{"id": "1", "name": "x", "seq": 0}, {"id": "2", "name": "y", "seq": 1}])
    for step in range(2):
        live.upsert(live.records(spark, str(src), schema), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
        if step == 0:
            put(src, "b.json", [{"id": "1", "name": "z", "seq": 5}])
    assert sorted((r["id"], r["name"], r["seq"]) for r in live.current(spark, str(tmp_path / "t")).collect()) == [("1", "z", 0), ("2", "y", 1)]

    ev = tmp_path / "ev"
    ev.mkdir()
    put(ev, "a.json", [{"state_id": "s", "kind": "declared", "source_ax_id": "a", "at": "2"}])
    put(ev, "b.json", [{"state_id": "s", "kind": "observed", "source_ax_id": "a", "at": "1"}, {"state_id": "s", "kind": "declared", "source_ax_id": "a", "at": "3"}])
    q = live.evidence_states(live.records(spark, str(ev), "state_id string, kind string, source_ax_id string, at string", 1)).writeStream.format("memory").queryName("ev").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.table("ev").orderBy(F.desc("sources")).first()
    assert (last["provenance"], last["sources"], last["first_observed_at"]) == ("declared+observed", 2, "1")


def test_windows_and_audit(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    put(src, "a.json", [{"principal": "p", "at": f"2024-01-01T00:00:{s:02d}Z"} for s in range(30)])
    stream = live.records(spark, str(src), "principal string, at timestamp")
    q = live.limited(live.attempts_by_window(stream, "30 seconds", "30 seconds"), 10).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["attempts"], r["limited"]) for r in spark.table("w").collect()] == [(30, True)]
    counts = live.auth_counts(live.records(spark, str(src), "principal string, at timestamp").withColumnRenamed("principal", "auth_id"))
    q = counts.writeStream.format("memory").queryName("auth").outputMode("complete").option("checkpointLocation", str(tmp_path / "c4")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("auth").first()["observation_count"] == 30
    live.audit_sink(live.records(spark, str(src), "principal string, at timestamp"), str(tmp_path / "log"), str(tmp_path / "c3")).awaitTermination()
    assert spark.read.json(str(tmp_path / "log")).count() == 30


def test_upserts_rewrite_only_touched_parts(spark, tmp_path):
    src, table = tmp_path / "in", tmp_path / "t"
    src.mkdir()
    schema, want = "id string, name string, seq long", {}
    for step in range(4):
        rows = [{"id": str(i), "name": f"{step}", "seq": step} for i in (range(300) if step == 0 else [step, 7])]
        put(src, f"{step}.json", rows)
        want |= {r["id"]: r["name"] for r in rows}
        live.upsert(live.records(spark, str(src), schema), str(table), str(tmp_path / "c")).awaitTermination()
        if step:
            assert len(list((table / f"v={step}").glob("part=*"))) <= 2
    assert {r["id"]: r["name"] for r in live.current(spark, str(table)).collect()} == want
    assert {r["seq"] for r in live.current(spark, str(table)).where("id <> '7'").collect()} <= {0}
