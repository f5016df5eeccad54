"""Git history as DataFrames: commits, tree entries and blobs, read from an object store without git.

``GitSource`` is a Python data source with three tables. Commits are walked on the driver of
the source (their number is that of a repository's history); trees and blobs are read in
partitions of commits. The rest is joins and aggregations.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Places that hold a commit, the most telling first.
PRIORITY = {"current branch": 6, "branch": 5, "remoteRef": 4, "tag": 3, "stash": 2, "dangling": 1}
COMMIT = "ref string, ref_kind string, commit string, parents array<string>, author_ts timestamp, subject string"
ENTRY = "ref string, ref_kind string, commit string, author_ts timestamp, subject string, path string, oid string"
BLOB = "oid string, content binary"


class Store:
    """Objects of a repository: loose files and packs."""

    def __init__(self, folder: str):
        self.folder = os.path.join(folder, ".git") if os.path.isdir(os.path.join(folder, ".git")) else folder
        packs = os.path.join(self.folder, "objects", "pack")
        self.packs = [_Pack(os.path.join(packs, f[:-4])) for f in sorted(os.listdir(packs)) if f.endswith(".idx")] if os.path.isdir(packs) else []

    def read(self, oid: str) -> tuple[str, bytes] | None:
        """(kind, content) of an object, or None."""
        path = os.path.join(self.folder, "objects", oid[:2], oid[2:])
        if os.path.isfile(path):
            with open(path, "rb") as file:
                head, _, body = zlib.decompress(file.read()).partition(b"\0")
            return head.split(b" ")[0].decode(), body
        for pack in self.packs:
            if (at := pack.find(bytes.fromhex(oid))) is not None:
                return pack.read(at, self)
        return None

    def all_ids(self) -> list[str]:
        root = os.path.join(self.folder, "objects")
        loose = [d + f for d in os.listdir(root) if re.fullmatch("[0-9a-f]{2}", d) for f in os.listdir(os.path.join(root, d))]
        return sorted({*loose, *(oid.hex() for pack in self.packs for oid in pack.ids())})

    def refs(self) -> list[tuple[str, str, str]]:
        """(name, kind, commit id) of heads, remotes, tags and the stash."""
        named: dict[str, str] = {}
        packed = os.path.join(self.folder, "packed-refs")
        if os.path.isfile(packed):
            with open(packed) as file:
                named |= {m[2]: m[1] for m in re.finditer(r"^([0-9a-f]{40}) (\S+)$", file.read(), re.M)}
        for base, _, files in os.walk(os.path.join(self.folder, "refs")):
            for f in files:
                path = os.path.join(base, f)
                with open(path) as file:
                    text = file.read().strip()
                if re.fullmatch("[0-9a-f]{40}", text):
                    named[os.path.relpath(path, self.folder)] = text
        head = os.path.join(self.folder, "HEAD")
        current = open(head).read().strip().removeprefix("ref: ") if os.path.isfile(head) else ""  # noqa: SIM115
        kinds = (("refs/heads/", "branch"), ("refs/remotes/", "remoteRef"), ("refs/tags/", "tag"), ("refs/stash", "stash"))
        found = []
        for name, oid in sorted(named.items()):
            kind = next((k for lead, k in kinds if name.startswith(lead)), None)
            if kind:
                lead = next(lead for lead, k in kinds if k == kind)
                found.append((name.removeprefix(lead) or "stash", "current branch" if name == current else kind, self.peeled(oid)))
        return [f for f in found if f[2]]

    def peeled(self, oid: str) -> str | None:
        """The commit that an id stands for, through annotated tags."""
        for _ in range(8):
            held = self.read(oid)
            if held is None or held[0] == "commit":
                return oid if held else None
            m = re.match(rb"object ([0-9a-f]{40})", held[1])
            if held[0] != "tag" or not m:
                return None
            oid = m[1].decode()
        return None

    def commit(self, oid: str) -> tuple[str, list[str], int, str] | None:
        """(tree, parents, author seconds, subject)."""
        held = self.read(oid)
        if held is None or held[0] != "commit":
            return None
        head, _, message = held[1].decode(errors="replace").partition("\n\n")
        tree, when = re.search(r"^tree (\S+)", head, re.M), re.search(r"^author .*> (-?\d+) ", head, re.M)
        return tree[1], re.findall(r"^parent (\S+)", head, re.M), int(when[1]) if when else 0, subject(message)

    def entries(self, tree: str, prefix: str = ""):
        """(path, blob id) of a tree's files."""
        stack = [(tree, prefix)]
        while stack:
            oid, lead = stack.pop()
            held = self.read(oid)
            raw, at = held[1] if held else b"", 0
            while at < len(raw):
                end = raw.index(b"\0", at)
                mode, _, name = raw[at:end].partition(b" ")
                child, at = raw[end + 1 : end + 21].hex(), end + 21
                path = lead + name.decode(errors="replace")
                if mode in (b"40000", b"040000"):
                    stack.append((child, path + "/"))
                elif mode.startswith(b"100"):
                    yield path, child


class _Pack:
    def __init__(self, stem: str):
        self.stem = stem
        with open(stem + ".idx", "rb") as file:
            self.index = file.read()
        self.fan = struct.unpack(">256I", self.index[8 : 8 + 1024])

    def ids(self):
        return (self.index[1032 + 20 * i : 1052 + 20 * i] for i in range(self.fan[255]))

    def find(self, oid: bytes) -> int | None:
        low, high = self.fan[oid[0] - 1] if oid[0] else 0, self.fan[oid[0]]
        while low < high:
            mid = (low + high) // 2
            own = self.index[1032 + 20 * mid : 1052 + 20 * mid]
            if own == oid:
                n = self.fan[255]
                offsets = 1032 + 24 * n
                at = struct.unpack(">I", self.index[offsets + 4 * mid : offsets + 4 * mid + 4])[0]
                if at & 0x80000000:
                    wide = offsets + 4 * n + 8 * (at & 0x7FFFFFFF)
                    at = struct.unpack(">Q", self.index[wide : wide + 8])[0]
                return at
            low, high = (mid + 1, high) if own < oid else (low, mid)
        return None

    def read(self, at: int, store: Store) -> tuple[str, bytes]:
        deltas, kinds = [], {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
        with open(self.stem + ".pack", "rb") as file:
            while True:
                file.seek(at)
                byte = file.read(1)[0]
                kind = byte >> 4 & 7
                while byte & 0x80:
                    byte = file.read(1)[0]
                base = None
                if kind == 6:
                    byte = file.read(1)[0]
                    back = byte & 0x7F
                    while byte & 0x80:
                        byte = file.read(1)[0]
                        back = (back + 1) << 7 | byte & 0x7F
                    base = at - back
                elif kind == 7:
                    base = file.read(20)
                unpack, body = zlib.decompressobj(), b""
                while not unpack.eof:
                    body += unpack.decompress(file.read(1 << 16))
                if kind in kinds:
                    return kinds[kind], functools.reduce(_patched, reversed(deltas), body)
                deltas.append(body)
                if kind == 7:
                    own, body = store.read(base.hex())
                    return own, functools.reduce(_patched, reversed(deltas), body)
                at = base


def _patched(base: bytes, delta: bytes) -> bytes:
    at, out = 0, []
    for _ in range(2):  # the sizes before and after
        while delta[at] & 0x80:
            at += 1
        at += 1
    while at < len(delta):
        op, at = delta[at], at + 1
        if op & 0x80:
            values = []
            for first, n in ((0, 4), (4, 3)):
                value = 0
                for k in range(n):
                    if op >> first + k & 1:
                        value, at = value | delta[at] << 8 * k, at + 1
                values.append(value)
            begin, size = values[0], values[1] or 0x10000
            out.append(base[begin : begin + size])
        else:
            out.append(delta[at : at + op])
            at += op
    return b"".join(out)


def subject(message: str) -> str:
    """A message's first line, without control characters."""
    return re.sub(r"[\x00-\x20\x7f]+", " ", message.strip().split("\n")[0]).strip()


def commits(store: Store) -> list[tuple]:
    """Rows of COMMIT: every commit once for each place that reaches it, and the ones that none reaches."""
    rows, reached = [], set()
    for name, kind, tip in store.refs():
        seen, stack = set(), [tip]
        while stack:
            oid = stack.pop()
            if oid in seen or (held := store.commit(oid)) is None:
                continue
            seen.add(oid)
            rows.append((name, kind, oid, held[1], datetime.fromtimestamp(held[2], UTC), held[3]))
            stack += held[1]
        reached |= seen
    for oid in store.all_ids():
        if oid not in reached and (held := store.commit(oid)):
            rows.append(("dangling", "dangling", oid, held[1], datetime.fromtimestamp(held[2], UTC), held[3]))
    return rows


class _Part(InputPartition):
    def __init__(self, rows: list):
        self.rows = rows


class _Reader(DataSourceReader):
    def __init__(self, folder: str, table: str, parts: int):
        self.folder, self.table, self.n = folder, table, parts

    def partitions(self):
        rows = commits(Store(self.folder)) if self.table != "blobs" else sorted({oid for r in {r[2]: r for r in commits(Store(self.folder))}.values() for _, oid in Store(self.folder).entries(Store(self.folder).commit(r[2])[0])})
        return [_Part(rows[k :: self.n]) for k in range(min(self.n, len(rows)))] or [_Part([])]

    def read(self, partition):
        store = Store(self.folder)
        for row in partition.rows:
            if self.table == "commits":
                yield row
            elif self.table == "entries":
                for path, oid in store.entries(store.commit(row[2])[0]):
                    yield (row[0], row[1], row[2], row[4], row[5], path, oid)
            else:
                held = store.read(row)
                if held and held[0] == "blob":
                    yield (row, held[1])


class GitSource(DataSource):
    """``spark.read.format("git_history").option("path", repo).option("table", "commits" | "entries" | "blobs")``."""

    @classmethod
    def name(cls):
        return "git_history"

    def schema(self):
        return {"commits": COMMIT, "entries": ENTRY, "blobs": BLOB}[self.options.get("table", "entries")]

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("table", "entries"), int(self.options.get("partitions", "8")))


def read(spark: SparkSession, folder: str, table: str = "entries") -> DataFrame:
    spark.dataSource.register(GitSource)
    return spark.read.format("git_history").option("path", folder).option("table", table).load()


def ancestors(spark: SparkSession, parents: DataFrame, tips: DataFrame) -> DataFrame:
    """(tip, commit): the commits that each of the tips (commit) reaches over (commit, parents), itself included: a recursive query."""
    edges = parents.select("commit", F.explode("parents").alias("parent")).distinct()
    edges.createOrReplaceTempView("_brindle_edges")
    tips.select("commit").distinct().createOrReplaceTempView("_brindle_tips")
    return spark.sql(
        """WITH RECURSIVE reach(tip, commit, depth) MAX RECURSION LEVEL 1000000 AS (
             SELECT commit, commit, 0 FROM _brindle_tips
             UNION ALL SELECT r.tip, e.parent, r.depth + 1 FROM reach r JOIN _brindle_edges e ON r.commit = e.commit)
           SELECT DISTINCT tip, commit FROM reach"""
    )


def cutoff(value: Column) -> Column:
    """The moment that a cut-off text stands for: RFC 3339, git's own date, or a day, which counts to its end in UTC; else null."""
    day = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(value, F.lit("yyyy-MM-dd")) + F.expr("INTERVAL '1' DAY") - F.expr("INTERVAL '1' SECOND"))
    exact = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}"), F.try_to_timestamp(value))
    m = r"^[A-Z][a-z]{2} ([A-Z][a-z]{2}) +(\d{1,2}) (\d{2}:\d{2}:\d{2}) (\d{4}) ([+-]\d{4})$"
    git = F.when(value.rlike(m), F.try_to_timestamp(F.regexp_replace(value, m, "$2 $1 $4 $3 $5"), F.lit("d MMM yyyy HH:mm:ss xx")))
    return F.coalesce(exact, git, day)


def resolved(rows: DataFrame, prefix: str) -> str | None:
    """The one commit whose id begins with a hex prefix, or None where there is none or more than one."""
    if not re.fullmatch("[0-9A-Fa-f]{4,40}", prefix):
        return None
    found = [r["commit"] for r in rows.where(F.col("commit").startswith(prefix.lower())).select("commit").distinct().limit(2).collect()]
    return found[0] if len(found) == 1 else None


def without_skipped(rows: DataFrame, exact: DataFrame | None = None, reached: DataFrame | None = None, until=None) -> DataFrame:
    """``rows`` (commit, author_ts, ...) without the exact commits (commit), the commits reached by a cut-off commit (commit), and those authored by ``until``."""
    for gone in (exact, reached):
        if gone is not None:
            rows = rows.join(gone.select("commit").distinct(), "commit", "left_anti")
    return rows if until is None else rows.where(F.col("author_ts") > F.lit(until))


def attributed(entries: DataFrame) -> DataFrame:
    """One row per blob: the earliest commit that has it with its path, the most telling place, and its commits by author time."""
    priority = F.element_at(F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair]), F.col("ref_kind"))
    commit = F.struct(F.col("author_ts").alias("author_ts"), F.col("commit").alias("commit"), F.col("subject").alias("subject"))
    best = F.struct(F.unix_micros("author_ts").alias("t"), F.col("commit").alias("commit"), F.col("path").alias("path"))
    return entries.groupBy("oid").agg(
        F.min(best)["commit"].alias("commit"), F.min(best)["path"].alias("path"), F.to_date(F.min("author_ts")).alias("author_date"),
        F.max(F.struct(priority.alias("p"), F.struct("ref_kind", "ref").alias("at")))["at"].alias("location"), F.sort_array(F.collect_set(commit)).alias("commits"),
    )


def as_json(blobs: DataFrame) -> Column:
    """A blob's history as a JSON object."""
    kind = F.col("location.ref_kind")
    place = F.struct(
        F.when(kind.endswith("branch"), "branch").otherwise(kind).alias("type"), F.when(kind.endswith("branch"), kind == "current branch").alias("current"), F.when(kind.isin("stash", "dangling"), None).otherwise(F.col("location.ref")).alias("name")
    )
    total = F.struct(F.element_at("commits", 1)["commit"].alias("oldest"), F.element_at("commits", -1)["commit"].alias("newest"), F.size("commits").alias("total"))
    also = F.col("also_in_working_tree") if "also_in_working_tree" in blobs.columns else F.lit(False)
    return F.to_json(F.struct("commit", F.col("author_date").cast("string").alias("authorDate"), also.alias("alsoInWorkingTree"), place.alias("location"), total.alias("commits")))


def blob_id(content: Column) -> Column:
    """The object id that git gives a file's bytes."""
    raw = content.cast("binary")
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(raw).cast("string")).cast("binary"), F.unhex(F.lit("00")), raw))


def with_history(files: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with the history of an equal blob, the blobs that no file equals): what is in the tree is scanned once."""
    ids = files.withColumn("oid", blob_id(F.col("content")))
    own = ids.join(blobs.drop("path").withColumn("also_in_working_tree", F.lit(True)), "oid", "left")
    return own, blobs.join(ids.select("oid").distinct(), "oid", "left_anti")
