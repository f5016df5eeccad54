"""Assignments from configuration files: line formats as column expressions, tree formats in Arrow batches.

Every function returns (id, name, value), with the line (from 1) where the format has lines.
Null and empty texts give no rows; repeated rows give repeated results; a text that does
not parse as its tree format gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Java's dialect and RE2's read this alike.
CONFIG = r"""^[ \t]*(?:export[ \t]+)?([^#!;\[ \t\r\n=:"'][^=: \t\r\n]*)[ \t]*[=:][ \t]*(?:"([^"\n]*)"|'([^'\n]*)'|([^\n]*?))(?:[ \t]+[#;][^\n]*)?[ \t\r]*\z"""
CONTINUED = r"\\\r?\n[ \t]*"
PGPASS = r"^(?:(?:\\.|[^:\\#])(?:\\.|[^:\\])*:|:)(?:(?:\\.|[^:\\])*:){3}((?:\\.|[^:\\])*)"
CREDENTIAL_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/@:]*):([^/@]+)@"
MAIL_PASSWORD = r"""^[ \t]*(?i:(password|passwd|pwd))[ \t]*[= \t][ \t]*["']?([^"'\r\n]+)"""
# The directives of a Redis configuration that hold a password.
REDIS_DIRECTIVES = ("masterauth", "requirepass", "tls-key-file-pass", "tls-replication-key-file-pass")
_REDIS = rf"""^[ \t]*(?i:({"|".join(REDIS_DIRECTIVES)}))[ \t]+["']?([^"' \t\r\n]+)"""
_REDIS_USER = r"^[ \t]*(?i:user)[ \t]+(\S+)[ \t]+"
_REDIS_RULE = r"(?<=[ \t])[><#!](\S+)"


def lines(docs: DataFrame, id_col: str, text_col: str, text=None) -> DataFrame:
    """(id, line, body) of each line."""
    parts = F.split(F.col(text_col) if text is None else text, "\n")
    return docs.select(F.col(id_col).alias("id"), F.posexplode(parts).alias("at", "body")).select("id", (F.col("at") + 1).alias("line"), "body")


def config(docs: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """`name = value` and `name: value` lines. A line that ends in a backslash continues; line numbers count joined lines."""
    found = lines(docs, id_col, text_col, F.regexp_replace(text_col, CONTINUED, "")).where(F.col("body").rlike(CONFIG))
    value = F.concat(*[F.regexp_extract("body", CONFIG, i) for i in (2, 3, 4)])
    return found.select("id", "line", F.regexp_extract("body", CONFIG, 1).alias("name"), value.alias("value")).where("value <> ''")


def netrc(docs: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """The word after each `password`."""
    words = F.split(F.trim(F.regexp_replace(text_col, r"\s+", " ")), " ")
    held = F.filter(F.transform(words, lambda w, i: F.when(F.get(words, i - 1) == "password", w)), lambda w: w.isNotNull())
    return docs.select(F.col(id_col).alias("id"), F.lit("password").alias("name"), F.explode(held).alias("value"))


def pgpass(docs: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """The fifth field of `host:port:database:user:password` lines; a backslash escapes."""
    found = lines(docs, id_col, text_col).select("id", "line", F.lit("password").alias("name"), F.regexp_replace(F.regexp_extract("body", PGPASS, 1), r"\\(.)", "$1").alias("value"))
    return found.withColumn("value", F.rtrim(F.regexp_replace("value", "\r", ""))).where("value <> ''")


def credential_urls(docs: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """The password of each line that is a URL with user and password."""
    found = lines(docs, id_col, text_col).where(F.col("body").rlike(CREDENTIAL_URL))
    return found.select("id", "line", F.regexp_extract("body", CREDENTIAL_URL, 1).alias("name"), F.try_url_decode(F.regexp_extract("body", CREDENTIAL_URL, 2)).alias("value"))


def mail_passwords(docs: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """`password`, `passwd` and `pwd` lines."""
    found = lines(docs, id_col, text_col).where(F.col("body").rlike(MAIL_PASSWORD))
    return found.select("id", "line", F.lower(F.regexp_extract("body", MAIL_PASSWORD, 1)).alias("name"), F.rtrim(F.regexp_extract("body", MAIL_PASSWORD, 2)).alias("value"))


def redis(docs: DataFrame, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """Password directives, and the passwords and hashes of `user` rules."""
    body = F.col("body")
    pair = lambda name, value: F.struct(name.alias("name"), value.alias("value"))
    direct = F.array(pair(F.lower(F.regexp_extract(body, _REDIS, 1)), F.regexp_extract(body, _REDIS, 2)))
    user = F.regexp_extract(body, _REDIS_USER, 1)
    rules = F.transform(F.regexp_extract_all(body, F.lit(_REDIS_RULE), F.lit(1)), lambda v: pair(user, v))
    found = lines(docs, id_col, text_col).where(body.rlike(_REDIS) | body.rlike(_REDIS_USER))
    return found.select("id", "line", F.explode(F.when(body.rlike(_REDIS), direct).otherwise(rules)).alias("p")).select("id", "line", "p.name", "p.value")


def _leaves(tree, name: str):
    """(dotted name, text) of a tree's strings, without recursion; members of a list share its name."""
    stack = [(name, tree)]
    while stack:
        name, node = stack.pop()
        if isinstance(node, str):
            yield name, node
        elif isinstance(node, dict):
            stack += [(f"{name}.{k}" if name else str(k), v) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            stack += [(name, v) for v in reversed(node)]


def tree(docs: DataFrame, kind: str, id_col: str = "path", text_col: str = "text") -> DataFrame:
    """Strings of JSON or TOML texts with their dotted keys (no lines)."""
    if kind not in ("json", "toml"):
        raise ValueError(f"no such format: {kind}")

    def run(frames):
        import json
        import tomllib

        import pyarrow as pa

        load = json.loads if kind == "json" else tomllib.loads
        for frame in frames:
            for key, text in zip(frame.column(0), frame.column(1).to_pylist(), strict=True):
                try:
                    found = list(_leaves(load(text or ""), ""))
                except (ValueError, RecursionError):
                    continue
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(found), frame.schema.field(0).type), pa.array([n for n, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], ["id", "name", "value"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, name string, value string")
