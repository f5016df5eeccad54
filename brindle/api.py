"""The library's entry points: scan a path, a proposed text or a table, with a repository's history or without it."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import files_scan, spans
from brindle.plans import reports
from brindle.sources import files, history, options


def scan_proposed(spark: SparkSession, name: str, content: str) -> DataFrame:
    """Findings of a text that is no file yet."""
    return files_scan.scan_files(spark.createDataFrame([(name, content)], "path string, text string"))


def scan_explicit(spark: SparkSession, paths: list[str], **more) -> DataFrame:
    """Findings of files that are named: no skip rule holds for them."""
    found = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files_scan.scan_files(found, **more)


def tree(spark: SparkSession, root: str, given: dict | None = None) -> tuple[DataFrame, options.Layers]:
    """The files below a root with ``skip_reason``, paths relative to it, and the tree's options.

    Paths are listed and judged first, and only files that stay are read.
    """
    listed = files.read_tree(spark, root)
    base = spark.createDataFrame([(root,)], "root string").select(F.regexp_replace("root", r"^file:/*|/+$", "")).first()[0].lstrip("/")
    relative = F.regexp_replace("path", rf"^[a-z0-9]+:/+\Q{base}\E/", "")
    named = listed.select(relative.alias("path"), F.col("path").alias("location"), "modified", "size", "content", "text")
    made = options.layers(named.select("path", "text"), given)
    return options.with_reason(named, made), made


def scan_path(spark: SparkSession, root: str, given: dict | None = None, state: DataFrame | None = None, **more) -> DataFrame:
    """Findings of a tree under its layered options; ``state`` is that of an incremental scan (path, modified, clean)."""
    found, made = tree(spark, root, given)
    top = made.at("x")
    kept = found.where("skip_reason IS NULL")
    if state is not None:
        kept = spans.changed_files(kept, state)
    result = files_scan.scan_files(kept.select("path", "content"), **more) if top.scans_tree else files_scan.scan_files(kept.select("path", "content").limit(0), **more)
    if top.scans_history:
        result = result.unionByName(scan_history(spark, root, kept.select("path", "content"), top, made, **more), allowMissingColumns=True)
    listed = spark.createDataFrame([(f,) for f in top.skip_fingerprints], "fingerprint string")
    return spans.without_known(result, listed) if top.skip_fingerprints else result


def scan_history(spark: SparkSession, root: str, working: DataFrame, own: options.Options, made: options.Layers, **more) -> DataFrame:
    """Findings of the blobs of a repository's history that the working tree doesn't have, with ``history``."""
    entries, commits = history.read(spark, root, "entries"), history.read(spark, root, "commits")
    exact, reached, until = None, None, None
    if own.skip_commits:
        exact = spark.createDataFrame([(history.resolved(commits, c) or c,) for c in own.skip_commits], "commit string")
    if own.skip_commits_up_to:
        until = spark.createDataFrame([(own.skip_commits_up_to,)], "v string").select(history.cutoff(F.col("v"))).first()[0]
        tip = None if until else history.resolved(commits, own.skip_commits_up_to)
        reached = history.ancestors(spark, commits, commits.where(F.col("commit") == tip)) if tip else None
    wanted = options.with_reason(history.without_skipped(entries, exact, reached, until), made).where("skip_reason IS NULL").drop("skip_reason")
    _, rest = history.with_history(working, history.attributed(wanted))
    blobs = rest.withColumn("history", history.as_json(rest)).select("oid", "path", "history").join(history.read(spark, root, "blobs"), "oid")
    found = files_scan.scan_files(blobs.select(F.concat_ws("\x1f", "oid", "path").alias("path"), "content"), **more)
    told = found.withColumns({"oid": F.split_part("path", F.lit("\x1f"), F.lit(1)), "path": F.split_part("path", F.lit("\x1f"), F.lit(2))})
    return told.join(blobs.select("oid", "history"), "oid", "left").drop("oid")


def report(spark: SparkSession, root: str, out: str, given: dict | None = None) -> int:
    """Scans a tree, writes the report that the options ask for and returns the exit code."""
    began = time.time()
    found, made = tree(spark, root, given)
    own = made.at("x")
    findings = scan_path(spark, root, given)
    summed = None
    if own.show_summary:
        summed = reports.summary_row(findings, found.where("skip_reason IS NULL AND text IS NOT NULL"), int(1000 * (time.time() - began))).first().asDict()
    reports.write(findings, out, own.output_format, summed, own.color)
    return reports.exit_code(findings)
