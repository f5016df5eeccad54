"""Reports: summaries and sinks for findings (columns of ``files_scan.FINDING``; absent ones count as null)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.files_scan import FINDING

# Rule identifiers with their texts, the table's columns, exit codes.
RULES = (
    ("secret-assignment", "Secret assigned to a named variable, constant, parameter, or property."),
    ("secret-value", "Secret value found in source code."),
    ("binary-secret", "Secret found in a binary file."),
    ("text-secret", "Secret found in a text file."),
    ("exposed-secret", "Secret written to program output, where it may be exposed to users or other systems."),
)
CSV_COLUMNS = (
    ("Severity", "severity"), ("Rule ID", "rule_id"), ("Name", "name"), ("Assignment Type", "assignment_type"), ("Description", "description"), ("Message", "message"), ("File", "path"),
    ("Start Line", "start_line"), ("Start Column", "start_col"), ("End Line", "end_line"), ("End Column", "end_col"), ("Fingerprint", "fingerprint"),
)
CLEAN, FOUND, FAILED = 0, 1, 2
FORMATS = ("csv", "json", "ndjson", "sarif", "junit", "xml", "text")
TOOL = "brindle"


def whole(findings: DataFrame) -> DataFrame:
    """``findings`` with every column of a finding; rows of failed files are left out."""
    kinds = dict(part.split() for part in FINDING.split(", "))
    made = findings.withColumns({n: F.lit(None).cast(k) for n, k in kinds.items() if n not in findings.columns})
    made = made.where("error IS NULL")
    return made if "description" in findings.columns or "detail" not in findings.columns else made.withColumn("description", F.col("detail"))


def summary(findings: DataFrame) -> DataFrame:
    """One row: critical, warning, total."""
    return findings.agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warning").alias("warning"), F.count(F.lit(1)).alias("total"))


def counted(n: Column, one: str, more: str) -> Column:
    """A count with its noun."""
    return F.concat(F.format_number(n, 0), F.lit(" "), F.when(n == 1, one).otherwise(more))


def summary_row(findings: DataFrame, files: DataFrame, milliseconds: int) -> DataFrame:
    """One row: scanned_files, elapsed_ms, critical, warning, total and the line that says so."""
    row = summary(whole(findings)).crossJoin(files.agg(F.count(F.lit(1)).alias("scanned_files"))).withColumn("elapsed_ms", F.lit(milliseconds).cast("long"))  # a row each
    took = f"{milliseconds / 1000:.2f}s" if milliseconds >= 1000 else f"{milliseconds}ms"
    secrets, warnings = counted(F.col("critical"), "secret", "secrets"), counted(F.col("warning"), "warning", "warnings")
    found = F.when(F.col("total") == 0, "No secrets found.").otherwise(F.concat(F.lit("Found "), F.when(F.col("warning") == 0, secrets).when(F.col("critical") == 0, warnings).otherwise(F.concat(secrets, F.lit(" and "), warnings)), F.lit(".")))
    return row.select("scanned_files", "elapsed_ms", "critical", "warning", "total", F.concat(F.lit("Scanned "), counted(F.col("scanned_files"), "file", "files"), F.lit(f" in {took}. "), found).alias("message"))


def exit_code(findings: DataFrame) -> int:
    """1 if there is any finding, 2 if a file failed and there is none, else 0."""
    if not whole(findings).isEmpty():
        return FOUND
    return FAILED if "error" in findings.columns and not findings.where("error IS NOT NULL").isEmpty() else CLEAN


def flagged(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(path, found): whether each file has a finding; the state of an incremental scan."""
    hit = findings.groupBy("path").agg(F.lit(True).alias("found"))
    return files.select("path").distinct().join(hit, "path", "left").select("path", F.coalesce("found", F.lit(False)).alias("found"))


def _ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("path", "start_line", "start_col", "rule_id")


def lines(findings: DataFrame, color: bool = False) -> DataFrame:
    """`SEVERITY path:line:col message [history] [validation] [fingerprint]` as column value."""
    own = whole(findings)
    place = F.concat_ws(":", "path", F.col("start_line").cast("string"), F.col("start_col").cast("string"))
    level = F.upper("severity")
    shown = F.when(F.col("severity") == "critical", F.concat(F.lit("\x1b[31m"), level, F.lit("\x1b[0m"))).otherwise(F.concat(F.lit("\x1b[33m"), level, F.lit("\x1b[0m"))) if color else level
    more = [F.concat(F.lit("["), F.col(c), F.lit("]")) for c in ("history", "validation", "fingerprint") if c in own.columns]
    return _ordered(own).select(F.concat_ws(" ", shown, place, "message", *more).alias("value"))


def json_object(findings: DataFrame) -> Column:
    """A finding as a JSON object."""
    names = ("rule_id", "ruleId"), ("severity", "severity"), ("name", "name"), ("assignment_type", "assignmentType"), ("description", "description"), ("message", "message"), ("path", "file"), ("start_line", "startLine"), ("start_col", "startColumn"), ("end_line", "endLine"), ("end_col", "endColumn"), ("fingerprint", "fingerprint")
    more = [(c, c) for c in ("history", "validation") if c in findings.columns]
    return F.to_json(F.struct(*[F.col(c).alias(shown) for c, shown in (*names, *more)]))


def sarif_result(findings: DataFrame) -> Column:
    """A finding as a SARIF 2.1.0 result."""
    region = F.when(F.col("start_line").isNotNull(), F.struct(F.col("start_line").alias("startLine"), F.col("start_col").alias("startColumn"), F.col("end_line").alias("endLine"), F.col("end_col").alias("endColumn")))
    uri = F.when(F.col("path").startswith("/"), F.concat(F.lit("file://"), "path")).otherwise(F.col("path"))
    place = F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return F.to_json(
        F.struct(
            F.col("rule_id").alias("ruleId"), F.when(F.col("severity") == "critical", "error").otherwise("warning").alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
            F.struct(F.col("fingerprint").alias(f"{TOOL}/v1")).alias("partialFingerprints"), F.array(place).alias("locations"),
            F.when(F.col("assignment_type").isNotNull(), F.struct(F.col("assignment_type").alias("assignmentType"))).alias("properties"),
        )
    )


def _safe(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")


def junit_case(findings: DataFrame) -> Column:
    """A finding as a `testcase` element."""
    attribute = lambda name, c: F.concat(F.lit(f' {name}="'), _safe(c), F.lit('"'))
    name = F.coalesce("name", "description")
    kind = F.when(F.col("assignment_type").isNotNull(), attribute("assignmentType", F.col("assignment_type"))).otherwise("")
    place = F.concat_ws(":", "path", F.col("start_line").cast("string"), F.col("start_col").cast("string"))
    return F.concat(
        F.lit("<testcase"), attribute("name", name), attribute("classname", F.col("rule_id")), attribute("fingerprint", F.col("fingerprint")), kind, F.lit("><failure"), attribute("message", F.col("message")),
        attribute("type", F.col("severity")), F.lit(">"), _safe(F.concat_ws(" ", F.upper("severity"), place, "message")), F.lit("</failure></testcase>"),
    )


def xml_element(findings: DataFrame) -> Column:
    """A finding as a `diagnostic` element."""
    names = ("severity", "severity"), ("ruleId", "rule_id"), ("name", "name"), ("assignmentType", "assignment_type"), ("description", "description"), ("message", "message"), ("file", "path"), ("startLine", "start_line"), ("startColumn", "start_col"), ("endLine", "end_line"), ("endColumn", "end_col"), ("fingerprint", "fingerprint")
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"<{shown}>"), _safe(F.col(c).cast("string")), F.lit(f"</{shown}>"))).otherwise("") for shown, c in names]
    return F.concat(F.lit("<diagnostic>"), *parts, F.lit("</diagnostic>"))


def document(findings: DataFrame, kind: str, summed: dict | None = None) -> DataFrame:
    """The lines of one enclosing document (column value). One task writes it, as a stream: a document is one file."""
    own = whole(findings)
    total = {"n": summed["total"] if summed else summary(own).first()["total"]}
    shown = {"json": json_object, "sarif": sarif_result, "junit": junit_case, "xml": xml_element}[kind](own)
    shared = json.dumps(summed) if summed else ""
    rules = json.dumps([{"id": i, "shortDescription": {"text": t}} for i, t in RULES])
    properties = "".join(f'<property name="{k}" value="{v}"/>' for k, v in (summed or {}).items())
    head, tail, comma = {
        "json": ('{"diagnostics": [', "]" + (f', "summary": {shared}' if shared else "") + "}", ","),
        "sarif": (
            f'{{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{{"tool": {{"driver": {{"name": "{TOOL}", "rules": {rules}}}}}, "results": [',
            "]" + (f', "properties": {{"{TOOL}Summary": {shared}}}' if shared else "") + "}]}",
            ",",
        ),
        "junit": (f'<?xml version="1.0" encoding="UTF-8"?>\n<testsuite name="{TOOL}" tests="{total["n"]}" failures="{total["n"]}" errors="0">' + (f"<properties>{properties}</properties>" if properties else ""), "</testsuite>", ""),
        "xml": ('<?xml version="1.0" encoding="UTF-8"?>\n<diagnostics>', "</diagnostics>", ""),
    }[kind]

    def joined(frames):
        import pyarrow as pa

        first = True
        for frame in frames:
            out = []
            for part, row in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                out.append(comma + row if part == 1 and not first else row)
                first = first and part != 1
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})

    order = ["path", "start_line", "start_col", "rule_id"]
    body = own.select(F.lit(1).alias("part"), shown.alias("value"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    ends = findings.sparkSession.createDataFrame([(0, head), (2, tail)], "part int, value string")
    rows = body.unionByName(ends, allowMissingColumns=True).repartition(1).sortWithinPartitions("part", "o0", "o1", "o2", "o3")
    return rows.select("part", "value").mapInArrow(joined, "value string")


def write(findings: DataFrame, path: str, kind: str, summed: dict | None = None, color: bool = False) -> None:
    """Writes findings in one of FORMATS below a folder. ``summed`` is a summary row to put into the document."""
    if kind == "csv":
        _ordered(whole(findings)).select(*[F.col(c).alias(shown) for shown, c in CSV_COLUMNS]).write.mode("overwrite").option("header", True).csv(path)
    elif kind == "ndjson":
        own = _ordered(whole(findings))
        own.select(json_object(own).alias("value")).write.mode("overwrite").text(path)
    elif kind == "text":
        lines(findings, color).write.mode("overwrite").text(path)
    elif kind in ("json", "sarif", "junit", "xml"):
        document(findings, kind, summed).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"format {kind!r} is none of {', '.join(FORMATS)}")


def state_after(state: DataFrame | None, files: DataFrame, findings: DataFrame, version: str) -> DataFrame:
    """The incremental state (path_hash, path, modified, clean, version) with the scanned files' rows put in; a state of another version is dropped."""
    own = flagged(findings, files).join(files.select("path", "modified").distinct(), "path").select(F.xxhash64("path").alias("path_hash"), "path", "modified", (~F.col("found")).alias("clean"), F.lit(version).alias("version"))
    if state is None:
        return own
    return state.where(F.col("version") == version).join(own.select("path_hash"), "path_hash", "left_anti").unionByName(own)
