"""Audit chains and alignments of groups that hold most rows."""

import random

from pyspark.sql import functions as F

from surfacegraph.operators import govern, layout


def test_a_long_chain_passes_a_batch_at_a_time(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        events = spark.range(3000).select(F.when(F.col("id") % 5 == 0, F.concat(F.lit("s"), F.col("id") % 3)).otherwise("long").alias("stream_id"), (3000 - F.col("id")).alias("seq"), F.col("id").cast("string").alias("body"))
        chain = govern.audit_chain(events)
        assert "FlatMapGroups" not in chain._jdf.queryExecution().optimizedPlan().toString()  # that needs a stream at once
        rows = chain.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    by = {}
    for r in rows:
        by.setdefault(r["stream_id"], []).append(r)
    assert {s: len(x) for s, x in by.items()} == {"long": 2400, "s0": 200, "s1": 200, "s2": 200}
    for s, chained in by.items():
        prev = ""
        for n, r in enumerate(sorted(chained, key=lambda r: r["sequence"]), 1):
            assert (r["sequence"], r["prev_hash"]) == (n, prev)
            prev = govern.chain_hash({"stream_id": s, "sequence": n, "body": r["body"], "prev_hash": prev})
            assert r["hash"] == prev
        assert [int(r["body"]) for r in sorted(chained, key=lambda r: r["sequence"])] == sorted((int(r["body"]) for r in chained), reverse=True)


def test_aligned_pairs_come_once_without_a_shuffle(spark):
    r = random.Random(5)
    rows = [("p", r.choice([None, "h"]), f"n{i}", tuple(float(r.randrange(40)) for _ in range(4))) for i in range(120)]
    nodes = spark.createDataFrame(rows, "page_id string, parent string, id string, rect struct<x:double,y:double,w:double,h:double>")

    def kind(a, b):
        if abs(a[1] - b[1]) <= layout.ALIGN and abs(a[3] - b[3]) <= layout.ALIGN:
            return "aligned-horizontally"
        if abs(a[0] - b[0]) <= layout.ALIGN and abs(a[2] - b[2]) <= layout.ALIGN:
            return "aligned-vertically"
        return "centred-with" if abs(a[0] + a[2] / 2 - b[0] - b[2] / 2) <= layout.CENTRE else None

    want = sorted(("p", i, j, k) for _, p, i, a in rows for _, q, j, b in rows if i != j and p == q and (k := kind(a, b)))
    pairs = layout.alignments(nodes)
    assert sorted(map(tuple, pairs.collect())) == want and len({k for *_, k in want}) == 3
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # what is made distinct are nodes, below the join
