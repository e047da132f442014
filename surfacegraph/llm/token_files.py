"""Token ids as flat binary files with 64-bit document offsets.

Each partition of the documents, in ascending id order, writes three files:
``.tokens`` (unsigned 16-bit ids where the vocabulary allows, else 32-bit),
``.offsets`` (unsigned 64-bit, one more than documents, counted within the
partition) and ``.docs`` (signed 64-bit document ids). A manifest has a row a
partition; the running sum of its token counts gives each partition's base.
Readers map the files into memory.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import workspace
from .text_tokens import encoder

MANIFEST = "part long, path string, width int, n_null long, n_docs long, n_tokens long"
#: Documents, and about how many ids, that a reader holds at a time.
STEP, IDS = 20_000, 1 << 22
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def partitions(docs: DataFrame, part_bytes: int) -> int:
    """How many partitions the rows go to: the session's number, or more, so that one has about ``part_bytes`` of the input as stored."""
    stored = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(n, min(1_000_000, stored // part_bytes))


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 1 << 26) -> DataFrame:
    """Encodes every whole text, appends ``end_id``, writes the files; returns the manifest with ``base``.

    Files grow with ``part_bytes`` of the stored input, not with the corpus.

    Null texts are empty. Null ids come first; rows that share an id are
    ordered by a hash of the text. The manifest names only files of successful
    tasks, so a task that runs twice leaves no trace in it. Repeated rows are
    documents of their own. An empty table has an empty manifest.
    """
    workspace.make_folder(folder)
    workspace.bound_batches(docs.sparkSession)

    def run(batches):
        codec, part = encoder(tokenizer), TaskContext.get().partitionId()
        kind = np.dtype("<u2") if max(codec.vocab_size, end_id + 1) <= 1 << 16 else np.dtype("<u4")
        tail, path = np.array([end_id], kind).tobytes(), f"{folder}/part-{part:05d}-{uuid.uuid4().hex}"
        total, n_docs, nulls = 0, 0, 0
        with workspace.open_out(path + ".tokens") as out, workspace.open_out(path + ".offsets") as ends, workspace.open_out(path + ".docs") as names:
            ends.write(np.zeros(1, "<u8").tobytes())
            for b in workspace.by_bytes(batches, 1):
                sizes = []
                for packed in codec.encode(b.column("t")):
                    out.write(np.frombuffer(packed, "<u4").astype(kind).tobytes() + tail)
                    sizes.append(len(packed) // 4 + 1)
                ids = b.column("doc_id")
                ends.write((total + np.cumsum(sizes)).astype("<u8").tobytes())
                names.write(pc.fill_null(ids, 0).to_numpy().astype("<i8").tobytes())
                total, n_docs, nulls = total + sum(sizes), n_docs + len(sizes), nulls + ids.null_count
        row = {"part": [part], "path": [path], "width": [kind.itemsize], "n_null": [nulls], "n_docs": [n_docs], "n_tokens": [total]}
        yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int64()), ("path", pa.string()), ("width", pa.int32()), ("n_null", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    n = partitions(docs, part_bytes)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    tie = F.xxhash64("t")
    ordered = rows.repartitionByRange(n, F.asc_nulls_first("doc_id"), tie).sortWithinPartitions(F.asc_nulls_first("doc_id"), tie)
    manifest = workspace.written(ordered.mapInArrow(run, MANIFEST), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files.

    ``ids_crc32`` is of the ids as little-endian unsigned 32-bit integers.
    """

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                with _File(r["path"] + ".offsets", "<u8") as offsets, _File(r["path"] + ".docs", "<i8") as docs, _File(r["path"] + ".tokens", f"<u{r['width']}") as tokens:
                    for at in range(0, r["n_docs"], STEP):
                        n = min(STEP, r["n_docs"] - at)
                        ends = offsets.part(at, at + n + 1).astype(np.int64)
                        crc, first = [], 0
                        while first < n:  # documents together up to so many ids; a longer one alone
                            last = max(first + 1, int(np.searchsorted(ends, ends[first] + IDS, "right")) - 1)
                            ids = tokens.part(int(ends[first]), int(ends[last])).astype("<u4")
                            cuts = ends[first : last + 1] - ends[first]
                            crc += [zlib.crc32(ids[a:z]) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                            first = last
                        names = pa.array(docs.part(at, at + n), mask=np.arange(at, at + n) < r["n_null"])
                        yield pa.RecordBatch.from_arrays(
                            [names, pa.array(ends[:-1] + r["base"]), pa.array(np.diff(ends)), pa.array(crc, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(run, DIGEST)


class _File:
    """A file of numbers, of which parts are read: mapped into memory where this machine sees it as a file."""

    def __init__(self, path: str, kind: str):
        self.kind, local = np.dtype(kind), workspace.local_path(path)
        self.stream, self.map = None, None
        if local is None:
            self.stream = workspace.open_at(path)
        elif os.path.getsize(local):
            self.map = np.memmap(local, self.kind, "r")

    def __enter__(self) -> _File:
        return self

    def __exit__(self, *_) -> None:
        if self.stream is not None:
            self.stream.close()

    def part(self, start: int, end: int) -> np.ndarray:
        if self.stream is not None:
            size = self.kind.itemsize
            return np.frombuffer(self.stream.read_at((end - start) * size, start * size), self.kind)
        return np.empty(0, self.kind) if self.map is None else self.map[start:end]
