"""Stateful streams by key: evidence with expiry, exact rate decisions, audit chains.

Each is a processor over keyed state that Spark keeps in its RocksDB store and
checkpoints with the stream, so a restart goes on where the last finished batch
ended, and a batch that runs again starts from the same state.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.govern import RATE, RATE_WINDOW_MS, chain_hash

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_store(spark: SparkSession) -> None:
    """Processors need the RocksDB store; a stream that was started with another keeps that by its checkpoint."""
    if "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") or ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


class Evidence(StatefulProcessor):
    """The evidence seen of a state, one entry a kind and source; entries older than ``ttl_ms`` count no more."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "kind string, source string", "at string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = False
        for r in rows:
            entry = (r["kind"] or "", r["source_ax_id"] or "")
            known = self.seen.getValue(entry) if self.seen.containsKey(entry) else None
            if known is None or (r["at"] is not None and (not known[0] or r["at"] < known[0])):
                self.seen.updateValue(entry, (r["at"] or "",))
            new = new or known is None
        if new:  # evidence that came before changes nothing
            entries = [(k[0], v[0]) for k, v in self.seen.iterator()]
            kinds = {kind.split(":")[0].split("-")[0] for kind, _ in entries}
            both = "declared+observed" if {"declared", "observed"} <= kinds else "observed" if "observed" in kinds else "declared"
            first = min((at for _, at in entries if at), default="")
            yield Row(state_id=key[0], provenance=both, sources=len(entries), first_observed_at=first)

    def close(self) -> None:
        pass


def evidence_states(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(state_id, provenance, sources, first_observed_at) after each batch with new evidence of a state.

    A replayed batch gives the same result. With ``ttl_ms`` evidence is
    forgotten so long after it was last written, in processing time, and so is
    a state of which nothing is left; a stream with expiry always has a next
    batch, so start it with a processing-time trigger, or ``once``, not with
    ``availableNow``. ``stream``: state_id, kind, source_ax_id, at string.
    """
    _with_store(stream.sparkSession)
    out = "state_id string, provenance string, sources int, first_observed_at string"
    mode = "ProcessingTime" if ttl_ms else "None"
    return stream.groupBy("state_id").transformWithState(Evidence(ttl_ms), out, "Update", mode)


class RateWindow(StatefulProcessor):
    """The attempts of a principal by their time. A timer decides on those of a moment once no earlier ones can come."""

    def __init__(self, limit: int, window_ms: int):
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.attempts = handle.getMapState("attempts", "at_ms long", "n long, ids array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            at = r["at_ms"]
            n, ids = self.attempts.getValue((at,)) if self.attempts.containsKey((at,)) else (0, [])
            if not n:
                self.handle.registerTimer(at)
            self.attempts.updateValue((at,), (n + 1, [*ids, r["attempt_id"]]))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        begin = now - self.window_ms
        counts = [(k[0], v[0]) for k, v in self.attempts.iterator()]
        total = sum(n for at, n in counts if begin < at <= now)
        n, ids = self.attempts.getValue((now,))
        for attempt in ids:
            yield Row(principal=key[0], attempt_id=attempt, at_ms=now, in_window=total, limited=total > self.limit)
        self.attempts.updateValue((now,), (n, []))
        for at, _ in counts:  # no later window reaches back to these
            if at <= begin:
                self.attempts.removeKey((at,))

    def close(self) -> None:
        pass


def rate_decisions(stream: DataFrame, limit: int = RATE, window_ms: int = RATE_WINDOW_MS, delay: str = "2 minutes") -> DataFrame:
    """(principal, attempt_id, at_ms, in_window, limited): one row an attempt, as ``govern.rate_limited`` gives for the whole table.

    An attempt is decided when the watermark, ``delay`` behind the latest
    attempt, has passed it; attempts that come later than that are dropped.
    State holds one window and the delay of a principal's attempts, a row a
    millisecond that has any. ``stream``: principal string, attempt_id string,
    at timestamp.
    """
    from pyspark.sql import functions as F

    _with_store(stream.sparkSession)
    timed = stream.withColumn("at_ms", F.unix_millis("at")).withWatermark("at", delay)
    out = "principal string, attempt_id string, at_ms long, in_window long, limited boolean"
    return timed.groupBy("principal").transformWithState(RateWindow(limit, window_ms), out, "Append", "EventTime")


class Chain(StatefulProcessor):
    """The head of an audit chain: the last sequence number and hash of a stream."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "sequence long, hash string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, prev = self.head.get() if self.head.exists() else (0, "")
        # the events of one stream in one batch
        for seq, body in sorted(((r["seq"], r["body"]) for r in rows), key=lambda e: (e[0] is not None, e[0] or 0, e[1] or "")):
            n += 1
            event = {"stream_id": key[0], "sequence": n, "body": body, "prev_hash": prev}
            row = event | {"hash": chain_hash(event)}
            prev = row["hash"]
            yield Row(**row)
        self.head.update((n, prev))

    def close(self) -> None:
        pass


def chained(stream: DataFrame) -> DataFrame:
    """(stream_id, sequence, body, prev_hash, hash): events chained on, batch after batch.

    The rule is that of ``govern.audit_chain``; a batch's events of a stream
    are sorted by ``seq``, and batches follow one another. ``stream``:
    stream_id, seq, body.
    """
    _with_store(stream.sparkSession)
    out = "stream_id string, sequence long, body string, prev_hash string, hash string"
    return stream.select("stream_id", "seq", "body").groupBy("stream_id").transformWithState(Chain(), out, "Append", "None")


def audit_log(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends audit events to JSON lines as one chain a stream, each event once, over batches and restarts."""
    return chained(stream).writeStream.format("json").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
