"""From texts to findings: assignments, payment cards and signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import fingerprint, names, values
from brindle.operators import spans
from brindle.sources import signatures

#: A name, a separator and a quoted value, or a bare one to the end of the word: for the SQL twins, whose names and values are bounded.
ASSIGNMENT = r"""[A-Za-z_][A-Za-z0-9_.-]{1,63}["']?[ \t]*[:=][ \t]*(?:"[^"\n]{1,512}"|'[^'\n]{1,512}'|[^\s"'<>,;]{1,512})"""
#: The same without bounds. A match begins at the first character of a run, so a run is read once; digits before the name are cut off.
WHOLE_ASSIGNMENT = r"""(?<![A-Za-z0-9_.-])[0-9.-]*+[A-Za-z_][A-Za-z0-9_.-]++["']?[ \t]*+[:=][ \t]*+(?:"[^"\n]++"|'[^'\n]++'|[^\s"'<>,;]++)"""
_PARTS = r"""^([A-Za-z_][A-Za-z0-9_.-]*)["']?[ \t]*[:=][ \t]*["']?([^"'\n]*)"""
CARD = r"[0-9][0-9 -]{11,22}[0-9]"


def assignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, name, value, start, line, column) of each assignment in column text."""
    text = F.col(text_col)
    hits = docs.where(text.rlike(WHOLE_ASSIGNMENT)).select(F.col(id_col).alias("id"), text.alias("text"), F.explode(spans.matches(text_col, WHOLE_ASSIGNMENT)).alias("m"))
    own = F.regexp_replace("m.match", "^[0-9.-]+", "")
    start = F.col("m.start") + F.char_length("m.match") - F.char_length(own)
    return hits.select(
        "id",
        F.regexp_extract(own, _PARTS, 1).alias("name"),
        F.regexp_extract(own, _PARTS, 2).alias("value"),
        start.alias("start"),
        F.char_length(own).alias("length"),
        spans.line_of(F.col("text"), start).alias("line"),
        spans.column_of(F.col("text"), start).alias("column"),
    )


def assignment_findings(found: DataFrame) -> DataFrame:
    """Assignments to credential names whose value may be a secret, with kind and severity."""
    value = values.normalized(F.col("value"))
    kinds = found.withColumn("kind", names.name_kind(names.name_words(F.col("name")))).withColumn("normal", value)
    return kinds.where(F.col("kind").isNotNull() & (F.char_length("normal") >= 8) & ~values.ruled_out(F.col("normal")) & values.sufficient_entropy(F.col("normal"))).select(
        "id", "name", "value", "kind", "start", "line", "column", F.lit("secret-assignment").alias("rule_id"), F.lit("warning").alias("severity"), F.concat(F.lit("Secret assigned to "), "name").alias("message")
    )


def cards(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, start, n_digits) of payment card numbers."""
    text = F.col(text_col)
    hits = docs.where(text.rlike(CARD)).select(F.col(id_col).alias("id"), F.explode(spans.matches(text_col, CARD)).alias("m"))
    return hits.where(values.is_card(F.col("m.match"))).select("id", F.col("m.start").alias("start"), F.char_length(F.regexp_replace("m.match", "[ -]", "")).alias("n_digits"))


def signature_findings(spark, docs: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """Findings of the signature catalogue, with fingerprints; public and placeholder entries are left out."""
    hits = spans.signature_hits(docs, id_col, text_col)
    named = hits.join(F.broadcast(signatures.catalogue(spark)), "ordinal").where("kind = 'secret'")
    return named.select(
        F.col("id").alias("path"), F.lit("secret-value").alias("rule_id"), F.lit("critical").alias("severity"), F.col("name").alias("detail"), "start", "end", "start_line", "start_col", "end_line", "end_col",
        F.concat(F.col("name"), F.lit(" found in content")).alias("message"), F.lit(True).alias("from_content_scan"), fingerprint.fingerprint_column(F.lit("secret-value"), F.col("secret")).alias("fingerprint"),
    )


def key_blocks(docs: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """(id, label, start) of PEM private-key blocks whose BEGIN and END labels agree."""
    label = r"([ A-Z0-9]*PRIVATE KEY(?: BLOCK)?)"
    pattern = rf"-{{4,5}} ?BEGIN {label} ?-{{4,5}}[ \t]*\r?\n[^-]*[A-Za-z0-9+/]{{20}}[^-]*-{{4,5}} ?END {label} ?-{{4,5}}"
    hits = docs.select(F.col(id_col).alias("id"), F.explode(spans.matches(text_col, pattern)).alias("m"))
    first, second = F.regexp_extract("m.match", pattern, 1), F.regexp_extract("m.match", pattern, 2)
    return hits.where(first == second).select("id", first.alias("label"), F.col("m.start").alias("start"))


def binary_secrets(files: DataFrame) -> DataFrame:
    """(path, kind) of key stores by their first bytes: JKS, JCEKS and KeePass files."""
    head = F.hex(F.substring("content", 1, 12))
    version = F.substring(head, 9, 8).isin("00000001", "00000002") & (F.substring(head, 17, 8) != "00000000")
    kind = (
        F.when(head.startswith("FEEDFEED") & version, "JKS")
        .when(head.startswith("CECECECE") & version, "JCEKS")
        .when(head.startswith("03D9A29A65FB4BB5"), "KeePass KDB")
        .when(head.startswith("03D9A29A67FB4BB5"), "KeePass KDBX")
    )
    return files.select("path", kind.alias("kind")).where("kind IS NOT NULL")
