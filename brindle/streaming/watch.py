"""Continuous scans: changed files, debounced events, and state by key, as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import files_scan, scan
from brindle.sources.options import IGNORE_FILE, RC_FILE


def scan_stream(spark: SparkSession, texts: DataFrame, sink: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text"):
    """Starts a query that writes the assignment findings of a stream of texts as Parquet, once each."""
    found = scan.assignment_findings(scan.assignments(texts, id_col, text_col))
    return found.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def debounced(events: DataFrame, key: str, time: str, gap: str = "128 milliseconds") -> DataFrame:
    """(key, first, last, n): bursts of a key's events with less than ``gap`` between them, in batch or stream."""
    return events.groupBy(F.col(key), F.session_window(time, gap).alias("w")).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n")).drop("w")


def file_changes(spark: SparkSession, root: str, only: str | None = None) -> DataFrame:
    """A stream of (path, modified, content) of the regular files below a root, once per file and change; ``only`` keeps one file."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root)
    found = found.select("path", F.col("modificationTime").alias("modified"), "content")
    return found if only is None else found.where(F.col("path").endswith(only))


def watch(changes: DataFrame, checkpoint: str, publish: Callable[[DataFrame, int], None], scanned: Callable[[DataFrame], DataFrame] = files_scan.scan_files, interval: str | None = None):
    """Starts the watch loop: each micro-batch is a burst of changes, of which every path's last one is scanned and published.

    ``publish`` gets the findings of the batch's files with ``cleared``, the paths whose earlier findings they
    replace. Without an interval the query ends when all changes are taken.
    """

    def burst(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("path").agg(F.max_by("content", "modified").alias("content"))
        publish(replacing(scanned(last), last), number)

    query = changes.writeStream.foreachBatch(burst).option("checkpointLocation", checkpoint)
    return (query.trigger(processingTime=interval) if interval else query.trigger(availableNow=True)).start()


def replacing(findings: DataFrame, files: DataFrame) -> DataFrame:
    """``findings`` and, for each scanned file without any, a row that only clears what was published before."""
    without = files.select("path").join(findings.select("path").distinct(), "path", "left_anti")
    return findings.withColumn("cleared", F.lit(False)).unionByName(without.withColumn("cleared", F.lit(True)), allowMissingColumns=True)


def published(before: DataFrame | None, batch: DataFrame) -> DataFrame:
    """All findings after a batch: a path's findings are the last batch's that has the path."""
    now = batch.where("NOT cleared").drop("cleared")
    return now if before is None else before.join(batch.select("path").distinct(), "path", "left_anti").unionByName(now)


def invalidated(changed: DataFrame, files: DataFrame) -> DataFrame:
    """The files to scan after changes: those changed, and all below the directory of a changed rc or ignore file."""
    name, folder = F.element_at(F.split("path", "/"), -1), F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
    rules = changed.where(name.isin(RC_FILE, IGNORE_FILE)).select(folder.alias("folder")).distinct()
    up = F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(F.split("path", "/"), 1, n), "/"), F.lit("/"))))
    below = files.select("path").distinct().select("path", F.explode(F.array_distinct(up)).alias("folder")).join(rules, "folder", "left_semi").select("path")
    wanted = below.union(changed.select("path")).distinct()
    return files.join(wanted, "path", "left_semi")


def open_documents(edits: DataFrame) -> DataFrame:
    """(uri, version, text, is_open): the state of each document after a stream of edits (uri, action, version, text).

    The state is kept by document and never expires; an edit older than the version held is left out.
    """
    out = "uri string, version int, text string, is_open boolean"

    def held(key, frames, state):
        import pandas as pd

        version, text, is_open = state.get if state.exists else (-1, None, False)
        for frame in frames:
            for row in frame.sort_values("version").itertuples():
                if row.version < version:
                    continue
                version, is_open = int(row.version), row.action != "close"
                text = row.text if is_open else None
        state.update((version, text, is_open))
        yield pd.DataFrame({"uri": [key[0]], "version": pd.array([version], dtype="int32"), "text": pd.array([text], dtype="object"), "is_open": [is_open]})

    return edits.groupBy("uri").applyInPandasWithState(held, out, "version int, text string, is_open boolean", "update", "NoTimeout")
