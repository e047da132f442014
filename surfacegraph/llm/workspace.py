"""Shared working tables and files.

Intermediate results that must survive a lost executor are written to the
folder that ``spark.checkpoint.dir`` names: every executor and the driver can
read it. The folder is read from the session; only where it is unset (a local
test session) is a temporary folder of this machine used instead.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder, without a trailing slash."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="surfacegraph-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


#: Folders of the blocks of :func:`transient` around the running code, the innermost last; each thread has its own.
_blocks: ContextVar[tuple[str, ...]] = ContextVar("blocks", default=())


def _folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/surfacegraph/{spark.sparkContext.applicationId}"


def _in(folder: str, label: str) -> str:
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet; it goes with the block of :func:`transient` around it."""
    return _in((_blocks.get() or (_folder(spark),))[-1], label)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage: what reads the result never recomputes ``df``, and the
    files outlive the executors that wrote them.
    """
    return _stored(df, new_path(df.sparkSession, label))


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def transient(spark: SparkSession) -> Iterator[None]:
    """Removes, at the end, the working tables that were made inside.

    For a step whose result has been written elsewhere: nothing may read the
    tables any more. They have a folder of their own, which goes whether the
    block ends or raises; blocks of other threads, or around this one, keep
    theirs. ``keep`` makes a table that outlives the block.
    """
    folder = _in((_blocks.get() or (_folder(spark),))[-1], "block")
    token = _blocks.set((*_blocks.get(), folder))
    try:
        yield
    finally:
        _blocks.reset(token)
        delete(spark, folder)


def keep(df: DataFrame, label: str) -> DataFrame:
    """:func:`written`, to a table that the innermost :func:`transient` leaves."""
    around = _blocks.get()[:-1] or (_folder(df.sparkSession),)
    return _stored(df, _in(around[-1], label))


def clear(spark: SparkSession) -> None:
    """Remove all working tables of this application."""
    delete(spark, _folder(spark))


def _filesystem(uri: str):
    """(pyarrow file system, path) of a URI; a bare path is local."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    """Create a folder (and its parents), from the driver or an executor."""
    system, path = _filesystem(uri)
    system.create_dir(path, recursive=True)


def open_out(uri: str):
    """A binary stream that writes a new file of the shared file system."""
    system, path = _filesystem(uri)
    return system.open_output_stream(path, compression=None)


def open_in(uri: str):
    """A binary stream that reads a file of the shared file system in order."""
    system, path = _filesystem(uri)
    return system.open_input_stream(path, compression=None)


def open_at(uri: str):
    """A file of the shared file system that is read at any place."""
    system, path = _filesystem(uri)
    return system.open_input_file(path)


def local_path(uri: str) -> str | None:
    """The path if this machine can map the file into memory, else None."""
    if uri.startswith("file:"):
        uri = "/" + uri[len("file:") :].lstrip("/")
    return uri if "://" not in uri and os.path.exists(uri) else None


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets Arrow batches of whole texts hold fewer rows, if the session has the default of 10,000.

    Executors and workers hold a few batches at a time; of long texts ten
    thousand are too many. Results do not depend on it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def settle() -> None:
    """Returns freed memory of a worker to the system; allocators keep it otherwise."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def by_bytes(batches, column: int, limit: int = 4_000_000):
    """The batches cut where the column's texts reach ``limit`` bytes, without copying.

    Bounds what a worker holds as Python objects at a time; a single text is
    never cut. Freed memory goes back to the system now and then.
    """
    import numpy as np
    import pyarrow.compute as pc

    for n, b in enumerate(batches, 1):
        if n % 4 == 0:
            settle()
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(ends // limit)) + 1).tolist(), b.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            yield b.slice(start, end - start)
    settle()


def fresh(taken, *names: str) -> list[str]:
    """The names, each lengthened until it clashes with none of ``taken``."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
