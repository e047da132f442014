"""Keyed state over several batches, restarts and replays."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from surfacegraph.operators import govern
from surfacegraph.streaming import keyed, live


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


@pytest.fixture(autouse=True)
def store(spark):
    """The store of processors, for these tests alone."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    yield
    spark.conf.set(key, before)


def run(df, checkpoint, path, mode, **trigger):
    """One run to the end of what is there; results go to a folder for each batch."""

    def write(batch, number):
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start().awaitTermination(240)


EVIDENCE = "state_id string, kind string, source_ax_id string, at string"
RESULT = "state_id string, provenance string, sources int, first_observed_at string, batch int"


def test_evidence_over_restarts_and_replays(spark, tmp_path):
    src, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    batches = [
        [{"state_id": "s", "kind": "declared", "source_ax_id": "a", "at": "2"}, {"state_id": "t", "kind": "observed", "source_ax_id": None, "at": None}],
        [{"state_id": "s", "kind": "declared", "source_ax_id": "a", "at": "2"}],  # replayed: no row
        [{"state_id": "s", "kind": "observed", "source_ax_id": "b", "at": "1"}, {"state_id": "s", "kind": "declared", "source_ax_id": "c", "at": "3"}],
    ]
    for n, rows in enumerate(batches):
        put(src, f"{n}.json", rows)
        run(keyed.evidence_states(live.records(spark, str(src), EVIDENCE, 1)), check, out, "update")
    got = sorted(tuple(r)[:4] for r in spark.read.schema(RESULT).json(out).collect())
    assert got == [("s", "declared", 1, "2"), ("s", "declared+observed", 3, "1"), ("t", "observed", 1, "")]


def test_evidence_expires(spark, tmp_path):
    src, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    for n, kind in enumerate(("declared", "observed")):
        put(src, f"{n}.json", [{"state_id": "s", "kind": kind, "source_ax_id": "a", "at": str(n)}])
        run(keyed.evidence_states(live.records(spark, str(src), EVIDENCE, 1), ttl_ms=1000), check, out, "update", once=True)
        time.sleep(2)
    got = sorted((r["provenance"], r["sources"], r["first_observed_at"]) for r in spark.read.schema(RESULT).json(out).collect())
    assert got == [("declared", 1, "0"), ("observed", 1, "1")]


def test_rate_decisions_equal_those_of_the_table(spark, tmp_path):
    """Attempts out of order, at equal times, in several batches with a restart after each."""
    rnd = random.Random(2)
    src, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    rows = [{"principal": rnd.choice("ab"), "attempt_id": str(i), "at_ms": 1_700_000_000_000 + i * 700 + rnd.randrange(0, 4000)} for i in range(120)]
    for r in rows[10:14]:
        r["at_ms"] = rows[10]["at_ms"]
    end = [{"principal": "z", "attempt_id": "end", "at_ms": 1_700_009_000_000}]
    schema = "principal string, attempt_id string, at_ms long"
    for n, part in enumerate((rows[:40], rows[40:80], [*rows[80:], *end])):
        put(src, f"{n}.json", part)
        stream = live.records(spark, str(src), schema, 1).withColumn("at", F.timestamp_millis("at_ms")).drop("at_ms")
        run(keyed.rate_decisions(stream, limit=8, window_ms=10_000, delay="10 seconds"), check, out, "append")
    got = sorted((r["attempt_id"], r["in_window"], r["limited"]) for r in spark.read.json(out).collect())
    whole = govern.rate_limited(spark.createDataFrame([tuple(r.values()) for r in rows], schema), 8, 10_000)
    assert got == sorted((r["attempt_id"], r["in_window"], r["limited"]) for r in whole.collect())
    assert len(got) == 120 and {r[2] for r in got} == {True, False}


def test_audit_chains_go_on_over_batches_and_restarts(spark, tmp_path):
    src, out, check = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "check")
    events = [{"stream_id": "ab"[i % 2], "seq": i, "body": f"e{i}" if i % 5 else None} for i in range(30)]
    for n in range(3):
        part = events[n * 10 : n * 10 + 10]
        put(src, f"{n}.json", part[::-1])
        keyed.audit_log(live.records(spark, str(src), "stream_id string, seq long, body string", 1), out, check).awaitTermination()
    log = spark.read.schema("stream_id string, sequence long, body string, prev_hash string, hash string").json(out)
    assert log.count() == 30 and govern.broken_links(log).count() == 0
    whole = govern.audit_chain(spark.createDataFrame([tuple(e.values()) for e in events], "stream_id string, seq long, body string"))
    same = ["stream_id", "sequence", "hash"]
    assert sorted(map(tuple, log.select(same).collect())) == sorted(map(tuple, whole.select(same).collect()))
    # a changed event breaks the chain behind it
    assert govern.broken_links(log.withColumn("hash", F.when(F.col("sequence") == 7, "x").otherwise(F.col("hash")))).count() == 2
