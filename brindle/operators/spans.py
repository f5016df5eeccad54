"""Spans of pattern matches, positions in text, and selections among overlapping spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import arrays
from brindle.scanner.scan import skipped_lines
from brindle.sources import signatures


def matches(text: str, pattern: str) -> Column:
    """Array of (match, start): all matches of a pattern in a column, with their 0-based code-point offsets."""
    p = arrays.literal(pattern)
    pair = "(p, m) -> named_struct('gap', char_length(p), 'match', m)"
    pairs = arrays.let("found", f"regexp_extract_all({text}, {p}, 0)", f"zip_with(slice(split({text}, {p}, -1), 1, size(found)), found, {pair})")
    placed = arrays.running(pairs, "STRUCT<gap: INT, match: STRING>", lambda x: f"{x}.gap + char_length({x}.match)", lambda a, b: f"{a} + {b}", 0)
    return F.expr(f"transform({placed}, e -> named_struct('match', e.item.match, 'start', e.before + e.item.gap))")


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    before = F.substring(text, F.lit(1), offset)
    return F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"))) + 1


def column_of(text: Column, offset: Column) -> Column:
    """1-based column, in code points."""
    return F.char_length(F.substring_index(F.substring(text, F.lit(1), offset), "\n", -1)) + 1


def signature_hits(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ordinal, start, end, start_line, start_col, end_line, end_col, secret): signatures' hits, without overlaps.

    One automaton over the signatures' required literals finds what may match, so most texts
    are read once at its speed. Places and the matched text are taken there, so ids need not
    be unique; null texts have no hits.
    """

    def run(frames):
        import pyarrow as pa

        own = signatures.matcher()
        for frame in frames:
            out = []
            for key, text in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                at = lambda i: (text.count("\n", 0, i) + 1, i - text.rfind("\n", 0, i))  # noqa: E731, B023
                out += [(key, i, start, end, *at(start), *at(end), text[start:end]) for start, end, i in own.hits(text)]
            columns = list(zip(*out, strict=True)) or [[]] * 9
            kinds = (pa.string(), *[pa.int32()] * 7, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["id", "ordinal", "start", "end", "start_line", "start_col", "end_line", "end_col", "secret"])

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return rows.mapInArrow(run, "id string, ordinal int, start int, end int, start_line int, start_col int, end_line int, end_col int, secret string")


def without_superseded(findings: DataFrame) -> DataFrame:
    """Findings that no other finding of their path supersedes.

    A content-scan finding loses to any overlapping extractor finding, and a finding to an enclosing one of
    higher severity; losers still supersede others. Furthest ends are running maxima over each path's
    findings in order, so a path with very many of them is sorted and never compared pair by pair.
    """
    rows = findings.withColumn("_id", F.struct(*[F.col(c) for c in findings.columns]))
    own = rows.select("path", F.col("start").alias("at"), F.lit(0).alias("turn"), F.when(~F.col("from_content_scan"), F.col("end")).alias("own_end"), F.when(F.col("severity") == "critical", F.col("end")).alias("high_end"), F.lit(None).cast(rows.schema["_id"].dataType).alias("_id"))
    asked = rows.select("path", (F.col("end") - 1).alias("at"), F.lit(1).alias("turn"), F.lit(None).cast("int").alias("own_end"), F.lit(None).cast("int").alias("high_end"), "_id")
    begun = rows.select("path", F.col("start").alias("at"), F.lit(2).alias("turn"), F.lit(None).cast("int").alias("own_end"), F.lit(None).cast("int").alias("high_end"), "_id")
    upto = Window.partitionBy("path").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("path").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("path", "at")
    told = own.unionByName(asked).unionByName(begun).withColumns({"own_reach": F.max("own_end").over(upto), "high_before": F.max("high_end").over(before), "high_same": F.max("high_end").over(same)})
    overlapped = (F.col("turn") == 1) & F.col("_id.from_content_scan") & (F.coalesce("own_reach", F.lit(-1)) > F.col("_id.start"))
    enclosed = (F.col("turn") == 2) & (F.col("_id.severity") != "critical") & ((F.coalesce("high_before", F.lit(-1)) >= F.col("_id.end")) | (F.coalesce("high_same", F.lit(-1)) > F.col("_id.end")))
    verdict = told.where("turn > 0").groupBy("_id", "turn").agg(F.max(overlapped | enclosed).alias("lost"), F.count(F.lit(1)).alias("times")).groupBy("_id").agg(F.max("lost").alias("lost"), F.max("times").alias("times"))
    kept = verdict.where("NOT lost").select(F.explode(F.array_repeat("_id", F.col("times").cast("int"))).alias("_id"))
    return kept.select("_id.*")


def call_parameters(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """(path, callee, seq, position, parameter, argument): the arguments of calls (path, callee, seq, args) with the parameters of the functions they call.

    Of the definitions (path, name, seq, params) of one name in a file the last counts.
    """
    last = definitions.groupBy("path", F.col("name").alias("callee")).agg(F.max_by("params", "seq").alias("params"))
    pairs = calls.join(last, ["path", "callee"]).select("path", "callee", "seq", F.posexplode("args").alias("position", "argument"), "params")
    return pairs.where(F.col("position") < F.size("params")).select("path", "callee", "seq", "position", F.get("params", F.col("position")).alias("parameter"), "argument")


def without_directed(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """Extractor findings outside their path's directive lines (path, first_line, last_line); other findings stay."""
    d = directives.select(F.col("path").alias("_path"), "first_line", "last_line")
    hit = (findings["path"] == d["_path"]) & findings["start_line"].between(d["first_line"], d["last_line"]) & ~findings["from_content_scan"]
    return findings.join(d, hit, "left_anti")


def directive_lines(files: DataFrame, marker: str = "brindle:skip", most: int = 20) -> DataFrame:
    """(path, first_line, last_line) covered by skip directives in column ``text``.

    A trailing directive covers its line; one on a line of its own covers the next line that isn't blank and
    the more deeply indented block below it, up to ``most`` lines or a blank one.
    """

    def run(frames):
        import pyarrow as pa

        for frame in frames:
            out = [(path, *lines) for path, text in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True) for lines in skipped_lines(text, marker, most)]
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32()), strict=True)], ["path", "first_line", "last_line"])

    return files.where(F.contains("text", F.lit(marker))).select("path", "text").mapInArrow(run, "path string, first_line int, last_line int")


def without_known(findings: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Findings whose fingerprint isn't in the suppression list."""
    return findings.join(fingerprints.select("fingerprint"), "fingerprint", "left_anti")


def changed_files(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files that the state table (path, modified, clean) doesn't list as clean at this modification time."""
    clean = state.where("clean").select("path", "modified")
    return files.join(clean, ["path", "modified"], "left_anti")
