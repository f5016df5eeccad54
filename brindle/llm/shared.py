"""What the corpus operators share: work folders, files on shared storage, bounded broadcasts."""

from __future__ import annotations

import atexit
import posixpath
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its counted rows stay within this many bytes.
BROADCAST_BYTES = 48_000_000


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which the driver and all executors share.

    Only where that setting is absent and Spark runs on one machine (tests), a temporary folder
    is made, set for the session and removed at exit; on a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="brindle-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", base)
    return posixpath.join(base, f"{label}-{uuid.uuid4().hex}")


def written(df: DataFrame, path: str) -> DataFrame:
    """The frame, cut from its lineage by a Parquet table on shared storage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_within(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its counted rows fit in ``limit`` bytes, else unchanged (a shuffle join)."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


_held: dict = {}


def remembered(key: tuple, build):
    """What this worker made for ``key`` before, or ``build()``. A new key replaces what was held.

    Workers outlive stages, so the caches of one operator are let go when another one runs.
    """
    if key not in _held:
        import pyarrow

        _held.clear()
        pyarrow.default_memory_pool().release_unused()
        _held[key] = build()
    return _held[key]


def filesystem(uri: str):
    """pyarrow's file system for a shared URI, and the path in it."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def put_file(uri: str, data: bytes, attempt: str) -> None:
    """Writes a whole file under a name of this attempt, then moves it: a retried task replaces it by equal bytes."""
    store, path = filesystem(uri)
    store.create_dir(posixpath.dirname(path), recursive=True)
    with store.open_output_stream(f"{path}.{attempt}") as out:
        out.write(data)
    store.move(f"{path}.{attempt}", path)


def get_file(uri: str) -> bytes:
    store, path = filesystem(uri)
    with store.open_input_stream(path) as source:
        return source.read()
