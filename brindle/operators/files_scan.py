"""Scans of whole files: one narrow stage of Arrow batches from (path, text or content) to findings.

Everything that must see a file's findings in order (repeats, directives, supersession) happens
where the file is read, so nothing is shuffled. Defined results: null and empty texts give
nothing; rows that repeat a path are scanned each; a file that fails gives one row with
``error`` set and every other column but path null; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.scanner import scan
from brindle.scanner.verdicts import Judge

FINDING = (
    "path string, file_type string, rule_id string, severity string, name string, assignment_type string, kind string, description string, message string, start int, end int, "
    "start_line int, start_col int, end_line int, end_col int, fingerprint string, from_content_scan boolean, error string"
)
CANDIDATE = "path string, file_type string, parsed boolean, kind string, name string, scope string, assignment_type string, value string, start int, end int, line int"
_NAMES = [part.split()[0] for part in FINDING.split(", ")]


def _place(text: str, at: int | None) -> tuple[int | None, int | None]:
    return (None, None) if at is None else (text.count("\n", 0, at) + 1, at - text.rfind("\n", 0, at))


def _batch(rows: list[tuple], schema: str):
    import pyarrow as pa

    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [part.split() for part in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def scan_files(files: DataFrame, mode: str = "sane", known: frozenset[str] | None = None, events: frozenset[str] = frozenset(), wordlist: tuple[str, ...] = ()) -> DataFrame:
    """The findings of (path, text) or, where there is a column ``content``, of (path, content).

    ``known`` are the dictionary's words (bounded by ``dictionary.learned``), ``events`` names of
    events that are no secrets, ``wordlist`` the 2048 words of mnemonic phrases.
    """
    binary = "content" in files.columns
    held = files.sparkSession.sparkContext.broadcast((known, events, wordlist))

    def run(frames):
        own, names, phrases = held.value
        for frame in frames:
            rows = []
            for path, body in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                if not body:
                    continue
                judge = Judge(path or "", known=own, events=names, wordlist=phrases)
                try:
                    kind, found = (scan.scan_bytes if binary else scan.scan_text)(path or "", body, judge, mode)
                    text = body if not binary else body.decode(errors="replace")
                    for f in found:
                        rows.append((path, kind, f.rule_id, f.severity, f.name, f.assignment_type, f.kind, f.detail, f.message, f.start, f.end, *_place(text, f.start), *_place(text, f.end), f.fingerprint, f.from_content_scan, None))
                except Exception as fault:  # noqa: BLE001 - one file's failure is a row, not the scan's end
                    rows.append((path, *[None] * (len(_NAMES) - 2), f"{type(fault).__name__}: {fault}"[:300]))
            yield _batch(rows, FINDING)

    return files.select("path", "content" if binary else "text").mapInArrow(run, FINDING)


def candidates(files: DataFrame) -> DataFrame:
    """What the extractors find in (path, text), before any classification."""

    def run(frames):
        for frame in frames:
            rows = []
            for path, text in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                kind, own = scan.items(path or "", text) if text else (None, [])
                for i in own or ():
                    rows.append((path, kind, True, i.kind, i.name, ".".join(i.scope) or None, i.assignment_type, i.value, i.start, i.end, _place(text, i.start)[0]))
                if own is None:
                    rows.append((path, kind, False, *[None] * 8))
            yield _batch(rows, CANDIDATE)

    return files.select("path", "text").mapInArrow(run, CANDIDATE)


def audit(files: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """(path, scanned, reason): the log of what is scanned and what is left out, and why."""
    reason = F.when(F.col("text").isNull(), "not text").when(F.col("text") == "", "empty")
    own = files.select("path", reason.alias("reason")).withColumn("scanned", F.col("reason").isNull())
    own = own.select("path", "scanned", "reason")
    return own if skipped is None else own.unionByName(skipped.select("path", F.lit(False).alias("scanned"), "reason"))
