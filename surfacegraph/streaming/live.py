"""Streams of captured records: upserts, counters, rate windows, audit. State by key is in :mod:`keyed`.

Records arrive as JSON lines or as any streaming source with the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.catalog import last_wins
from .keyed import evidence_states

__all__ = ["attempts_by_window", "audit_sink", "auth_counts", "current", "evidence_states", "limited", "records", "upsert"]


def records(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of JSON lines from a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


#: Parts of an upserted table; a batch rewrites only those that it touches.
PARTS = 64


def _part(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def _versions(spark: SparkSession, table: str) -> dict[int, list[int]]:
    """Finished versions of each part of a table, in order."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return {}
    names = lambda p: [s.getPath().getName() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(p))]
    out: dict[int, list[int]] = {}
    for v in sorted(int(n[2:]) for n in names(table) if n.startswith("v=")):
        inside = names(f"{table}/v={v}")
        if "_SUCCESS" in inside:
            for n in inside:
                if n.startswith("part="):
                    out.setdefault(int(n[5:]), []).append(v)
    return out


def _read(spark: SparkSession, table: str, newest: dict[int, int]) -> DataFrame | None:
    return spark.read.parquet(*[f"{table}/v={v}/part={p}" for p, v in sorted(newest.items())]) if newest else None


def upsert(stream: DataFrame, table: str, checkpoint: str, key: str = "id", order: str = "seq") -> StreamingQuery:
    """Keeps ``table`` (a folder) at the last row of each key.

    The table lies in parts by a hash of the key. Each batch writes a new
    version of the parts that it touches and leaves the others; of each part
    the newest version and the one before the batch stay, so a batch that runs
    again finds what it started from.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("part", _part(key))
        touched = [r["part"] for r in rows.select("part").distinct().collect()]  # at most PARTS
        if not touched:
            return
        known = _versions(spark, table)
        before = {p: max(older) for p in touched if (older := [v for v in known.get(p, []) if v < batch_id])}
        old = _read(spark, table, before)
        both = batch if old is None else old.select(batch.columns).unionByName(batch)
        merged = last_wins(both, key, order).withColumn("part", _part(key))
        merged.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{table}/v={batch_id}")
        jvm = spark.sparkContext._jvm
        for p in touched:
            for v in known.get(p, []):
                if v < batch_id and v != before.get(p):
                    gone = jvm.org.apache.hadoop.fs.Path(f"{table}/v={v}/part={p}")
                    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str) -> DataFrame | None:
    """The table as of the last finished batch."""
    return _read(spark, table, {p: max(v) for p, v in _versions(spark, table).items()})


def auth_counts(stream: DataFrame) -> DataFrame:
    """Running numbers of observations of each authentication context, of all time. ``stream``: auth_id, at timestamp."""
    return stream.groupBy("auth_id").agg(F.count(F.lit(1)).alias("observation_count"), F.min("at").alias("first_observed_at"))


def attempts_by_window(stream: DataFrame, window: str = "60 seconds", slide: str = "10 seconds", delay: str = "2 minutes") -> DataFrame:
    """Attempts of each principal in sliding windows; late rows count until the watermark. ``stream``: principal, at timestamp."""
    return stream.withWatermark("at", delay).groupBy(F.window("at", window, slide), "principal").agg(F.count(F.lit(1)).alias("attempts")).select("window.start", "window.end", "principal", "attempts")


def limited(windows: DataFrame, limit: int = 1000) -> DataFrame:
    return windows.withColumn("limited", F.col("attempts") > limit)


def audit_sink(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends events to a folder of JSON lines, batch by batch. For a log whose events are chained see ``keyed.audit_log``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").json(f"{folder}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
