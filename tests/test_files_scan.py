"""Whole-file scans, trees, history, incremental state and streams on Spark."""

import os
import subprocess
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import brindle.__main__ as cli
from brindle import api
from brindle.operators import files_scan, spans
from brindle.plans import fixtures, reports
from brindle.scanner import dictionary
from brindle.sources import history
from brindle.streaming import watch

A, B = fixtures.A, fixtures.B


def test_odd_rows(spark):
    rows = [("a.py", None), ("b.py", ""), (None, f'password = "{A}"'), ("c.py", "x = 1"), ("d.py", f'password = "{A}"'), ("d.py", f'password = "{A}"')]
    df = spark.createDataFrame([(p, t, "x") for p, t in rows], "path string, text string, kind string")
    got = files_scan.scan_files(df).collect()
    assert sorted((r.path or "", r.start_line, r.start_col) for r in got) == [("", 1, 1), ("d.py", 1, 12), ("d.py", 1, 12)]
    assert files_scan.scan_files(df.limit(0)).count() == 0 and files_scan.candidates(df).where("parsed").count() == 3
    assert sorted((r.path or "", r.scanned, r.reason) for r in files_scan.audit(df.distinct()).collect())[:3] == [("", True, None), ("a.py", False, "not text"), ("b.py", False, "empty")]
    whole = spark.createDataFrame([("a.bin", bytearray(b"\xff\xfe")), ("b.env", bytearray(f"K_TOKEN={A}".encode())), ("c.p12", bytearray.fromhex(fixtures.BINARIES[5][1]))], "path string, content binary")
    assert sorted((r.path, r.rule_id) for r in files_scan.scan_files(whole).collect()) == [("b.env", "secret-assignment"), ("c.p12", "binary-secret")]


def test_learned_dictionary(spark):
    texts = spark.createDataFrame([("purple monkey",), ("purple dishwasher monkey",), ("rare purple",), (None,)], "text string")
    assert dictionary.learned(texts, least=2) == {"purple", "monkey"} and dictionary.learned(texts, least=1, most=1) == {"purple"}


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    env = {**os.environ, "GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b.org", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b.org", "GIT_CONFIG_GLOBAL": "/dev/null"}

    def git(*arguments, day=1):
        when = {"GIT_AUTHOR_DATE": f"2024-01-{day:02d}T00:00:00Z", "GIT_COMMITTER_DATE": f"2024-01-{day:02d}T00:00:00Z"}
        return subprocess.run(["git", *arguments], cwd=root, env=env | when, check=True, capture_output=True, text=True).stdout.strip()

    git("init", "-q", "-b", "main")
    (root / "old.py").write_text(f'password = "{A}"\n' + "# filler\n" * 200)
    git("add", "."), git("commit", "-qm", "first\x07 line", day=1)
    (root / "old.py").write_text('password = ""\n' + "# filler\n" * 200)
    (root / "new.py").write_text(f'token = "{B}"\n')
    git("add", "."), git("commit", "-qm", "second", day=2)
    git("tag", "-a", "v1", "-m", "t")
    git("checkout", "-qb", "side"), (root / "side.py").write_text(f'secret = "{B}"\n')
    git("add", "."), git("commit", "-qm", "third", day=3), git("checkout", "-q", "main")
    git("gc", "-q")
    (root / "late.py").write_text("x = 1\n")
    git("add", "."), git("commit", "-qm", "fourth", day=4)
    return root, {f"c{i}": c for i, c in enumerate(git("log", "--all", "--format=%H", "--reverse", "--date-order").split("\n"), 1)}


def test_history(spark, repository):
    root, ids = repository
    commits, entries = history.read(spark, str(root), "commits"), history.read(spark, str(root), "entries")
    assert {(r.ref, r.ref_kind) for r in commits.select("ref", "ref_kind").distinct().collect()} == {("main", "current branch"), ("side", "branch"), ("v1", "tag")}
    assert commits.select("commit").distinct().count() == 4 and commits.where("subject = 'first line'").count() == 3
    blobs = {r.path: r for r in history.attributed(entries).collect() if r.path != "old.py"}
    assert (blobs["new.py"].commit, blobs["new.py"].location.ref_kind, [c.commit for c in blobs["new.py"].commits]) == (ids["c2"], "current branch", [ids["c2"], ids["c3"], ids["c4"]])
    assert blobs["side.py"].location.ref == "side"
    old = entries.where("path = 'old.py'").select("oid").distinct()
    assert {bytes(r.content)[:8] for r in history.read(spark, str(root), "blobs").join(old, "oid").collect()} == {b"password"}
    assert {r.commit for r in history.ancestors(spark, commits, commits.where(F.col("commit") == ids["c3"])).collect()} == {ids["c1"], ids["c2"], ids["c3"]}
    assert history.resolved(commits, ids["c1"][:8]) == ids["c1"] and history.resolved(commits, "zz") is None and history.resolved(commits, "0" * 39) is None
    assert history.without_skipped(commits, commits.where(F.col("commit") == ids["c4"])).select("commit").distinct().count() == 3


def test_tree_with_history(spark, repository, tmp_path):
    root, _ = repository
    got = {(r.path, r.history is not None) for r in api.scan_path(spark, str(root), {"deep": "true"}).collect()}
    assert got == {("new.py", False), ("old.py", True), ("side.py", True)}
    assert {r.path for r in api.scan_path(spark, str(root), {"deep": "history-only", "skip_commits_up_to": "2024-01-02"}).collect()} == {"side.py"}
    assert {r.path for r in api.scan_explicit(spark, [str(root / "new.py")]).select(F.element_at(F.split("path", "/"), -1).alias("path")).collect()} == {"new.py"}
    assert api.scan_proposed(spark, "x.py", f'password = "{A}"').count() == 1
    out = tmp_path / "report"
    assert cli.main(["scan", str(root), "--output-file", f"file://{out}", "--output-format", "text"]) == 1
    assert "new.py:1:9" in "".join(p.read_text() for p in out.glob("part-*")) and cli.main(["scan", str(tmp_path / "none"), "--output-file", f"file://{out}"]) == 2


def test_incremental_state(spark):
    files = spark.createDataFrame([("a.py", 1, f'password = "{A}"'), ("b.py", 1, "x = 1")], "path string, modified int, text string")
    state = reports.state_after(None, files, files_scan.scan_files(files), "v1")
    assert {(r.path, r.clean) for r in state.collect()} == {("a.py", False), ("b.py", True)}
    assert [r.path for r in spans.changed_files(files, state).collect()] == ["a.py"]
    later = files.withColumn("modified", F.lit(2)).where("path = 'b.py'")
    after = reports.state_after(state, later, files_scan.scan_files(later), "v1")
    assert {(r.path, r.modified) for r in after.collect()} == {("a.py", 1), ("b.py", 2)} and reports.state_after(state, later, files_scan.scan_files(later), "v2").count() == 1
    assert reports.exit_code(files_scan.scan_files(files)) == 1 and reports.exit_code(files_scan.scan_files(later)) == 0


def test_watch(spark, tmp_path):
    root, state = tmp_path / "tree", {"now": None}
    root.mkdir()

    def publish(batch, number):
        path = f"file://{tmp_path}/published-{number}-{len(list(tmp_path.iterdir()))}"
        watch.published(state["now"], batch).write.parquet(path)
        state["now"] = spark.read.parquet(path)

    def run():
        watch.watch(watch.file_changes(spark, f"file://{root}"), f"file://{tmp_path}/cp", publish).awaitTermination()
        return sorted(Path(r.path).name for r in state["now"].collect())

    (root / "a.py").write_text(f'password = "{A}"')
    (root / "b.py").write_text(f'password = "{B}"')
    assert run() == ["a.py", "b.py"]
    (root / "c.py").write_text(f'password = "{A}"')
    assert run() == ["a.py", "b.py", "c.py"]
    batch = watch.replacing(files_scan.scan_files(spark.createDataFrame([("p", "x")], "path string, text string")), spark.createDataFrame([("p",)], "path string"))
    assert [(r.path, r.cleared) for r in batch.collect()] == [("p", True)]
    files = spark.createDataFrame([("a.py",), ("x/b.py",), ("x/y/c.py",), ("z/d.py",)], "path string")
    changed = spark.createDataFrame([("x/.gitignore",), ("z/d.py",)], "path string")
    assert sorted(r.path for r in watch.invalidated(changed, files).collect()) == ["x/b.py", "x/y/c.py", "z/d.py"]


def test_open_documents(spark, tmp_path):
    edits = [("u", "open", 1, "a"), ("u", "change", 3, "c"), ("u", "change", 2, "b"), ("v", "open", 1, "x"), ("v", "close", 2, None)]
    spark.createDataFrame(edits, "uri string, action string, version int, text string").coalesce(1).write.parquet(f"file://{tmp_path}/edits")
    stream = spark.readStream.schema("uri string, action string, version int, text string").parquet(f"file://{tmp_path}/edits")
    watch.open_documents(stream).writeStream.format("memory").queryName("open_documents").outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/cp").start().awaitTermination()
    assert {(r.uri, r.version, r.text, r.is_open) for r in spark.table("open_documents").collect()} == {("u", 3, "c", True), ("v", 2, None, False)}
