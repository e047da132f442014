"""Rate windows and the steps of enforcement against brute force."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from surfacegraph import catalogue
from surfacegraph.operators import govern


def test_rate_windows_equal_brute_force(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["a", "b", None]), r.choice([None, *range(0, 400, 7)]), r.choice(["op", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "seq long, principal string, at_ms long, operation string")
    for counted in (None, "operation"):
        got = {x["seq"]: (x["in_window"], x["limited"]) for x in govern.rate_limited(df, 9, 50, counted=counted).collect()}

        def held(p, t):
            return sum(1 for _, q, u, op in rows if q == p and (counted is None or op) and ((t is None and u is None) or (None not in (t, u) and t - 50 < u <= t)))

        assert got == {i: (n := held(p, t), n > 9) for i, p, t, _ in rows}


@pytest.mark.parametrize("busy", [True, False])
def test_no_task_holds_the_window_of_a_principal(spark, busy):
    """A frame that slides is summed anew for every row, over all attempts in it: the square of a busy principal's."""
    df = spark.range(100).select(F.col("id").alias("seq"), (F.lit("p") if busy else F.col("id").cast("string")).alias("principal"), F.col("id").alias("at_ms"))
    assert "RangeFrame" not in govern.rate_limited(df)._jdf.queryExecution().analyzed().toString()


def test_postures_in_turn_equal_single_runs(spark):
    df = spark.range(60).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "graph_query").when(F.col("id") % 3 == 1, "crawl").otherwise("none").alias("tool"), F.lit("p").alias("principal"), F.col("id").alias("at_ms"),
        F.lit("web").alias("substrate"), F.lit("t").alias("target"), (F.col("id") % 2 == 0).alias("confirm"),
    )
    known = govern.measured(df, 5, 10)
    twice = govern.judge(govern.judge(known, "audit").withColumnRenamed("denial", "audit"), "copilot")
    got = {x["seq"]: (x["audit"], x["denial"]) for x in twice.collect()}
    one = lambda p: {x["seq"]: x["denial"] for x in govern.gateway(df, p, None, 5, 10).collect()}
    a, b = one("audit"), one("copilot")
    assert got == {i: (a[i], b[i]) for i in range(60)} and len(set(got.values())) > 3
    assert "cookie_denied" not in govern.gateway(df, "audit").columns


def test_moments_between_milliseconds(spark, tmp_path):
    """Moments count to the nearest millisecond, as in the SQL: half of one more or less decides at the edge of a window."""
    at = datetime(2024, 1, 1)
    rows = [(i, at + timedelta(microseconds=m), 0) for i, m in enumerate((600, 5_999_999_400 + 1000, 6_000_000_400, 6_000_001_500, 12_000_000_000))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, catalogue.queries()["g_rate_window"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(con.sql(catalogue.oracle_sql()["g_rate_window"]).fetchall())
