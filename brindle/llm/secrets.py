"""Secret scan with multipart credential linking [native].

Base kinds (assign, access, hex) are reported whenever they match. Weak kinds (a login, a
short secret, an endpoint) are common in harmless text; each is reported only when the
parts that complete it lie in its scope, the ``SCOPE`` code points around it: a login needs
a secret, a secret needs an identifier, an endpoint needs both. The interval join of a
document's parts is a sweep over sorted arrays inside the row, so no document's spans ever
meet another's, nothing is shuffled, and a text of very many spans costs no square of them.

Positions come from ``split`` and ``regexp_extract_all`` with one pattern: a match starts
after the pieces and matches before it. They count code points; ends are exclusive.

Defined results: a null or empty text has no spans, counts of 0 and the digest of an empty
string; rows are independent, so repeated rows and ids give repeated results; an empty
table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import arrays

SCOPE = 200


def either_case(words: str) -> str:
    """The pattern with every letter as a class of both cases: equal in every regex dialect."""
    return re.sub(r"[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


_BINDS = r"""["']?\x20*[:=]\x20*["']?"""
_ASSIGN = f"({either_case('password|passwd|secret|token|api_?key')}){_BINDS}([A-Za-z0-9+/_.=-]+)"
#: kind, role, weak, pattern, and the least and most characters of the pattern's group 2, where it has one.
KINDS = (
    ("assign", "secret", False, _ASSIGN, 8, None),
    ("access", "identifier", False, "AKIA[A-Z0-9]{12,}", None, None),
    ("hex", "secret", False, "[0-9a-f]{32,}", None, None),
    ("login", "identifier", True, f"(?:{either_case("user(?:name)?|login|client_?id|account|key_?id")}){_BINDS}[A-Za-z0-9@._-]{{3,}}", None, None),
    ("phrase", "secret", True, f"(?:{either_case('pass|pwd|auth|credential|private_?key|secret_?(?:access_?)?key|access_?key')}){_BINDS}[A-Za-z0-9+/_.=-]{{4,}}", None, None),
    ("endpoint", "endpoint", True, r"[A-Za-z][A-Za-z0-9+]{1,15}://[A-Za-z0-9._:@-]{4,}", None, None),
    ("short", "secret", True, _ASSIGN, 4, 7),
)
COMPLEMENTS = {"identifier": ("secret",), "secret": ("identifier",), "endpoint": ("identifier", "secret")}
_SPAN = "STRUCT<start: INT, rank: INT, end: INT, kind: STRING>"
_NONE = f"CAST(array() AS ARRAY<{_SPAN}>)"


def _positions(kind: str, pattern: str, least: int | None, most: int | None) -> Column:
    """Structs (start, rank, end, kind) of one kind's matches in column ``text``, in order."""
    rank, p = [k[0] for k in KINDS].index(kind), arrays.literal(pattern)
    value = f"char_length(regexp_extract(m, {p}, 2))" if least else "0"
    pair = f"(p, m) -> named_struct('gap', char_length(p), 'length', char_length(m), 'value', {value})"
    pairs = arrays.let("found", f"regexp_extract_all(text, {p}, 0)", f"zip_with(slice(split(text, {p}, -1), 1, size(found)), found, {pair})")
    placed = arrays.running(pairs, "STRUCT<gap: INT, length: INT, value: INT>", lambda x: f"{x}.gap + {x}.length", lambda a, b: f"{a} + {b}", 0)
    wanted = f"filter({placed}, e -> e.item.value BETWEEN {least} AND {most or 2**31 - 1})" if least else placed
    span = f"named_struct('start', e.before + e.item.gap, 'rank', {rank}, 'end', e.before + e.item.gap + e.item.length, 'kind', '{kind}')"
    return F.expr(f"CASE WHEN text RLIKE {p} THEN transform({wanted}, e -> {span}) ELSE {_NONE} END")


def _in_scope(spans: str, parts: str) -> str:
    """The spans that have one of the parts within ``SCOPE``: a sweep over both, sorted.

    A part is met when it starts by the span's end and SCOPE more, and ends by the span's start
    less SCOPE or after. So parts are passed by their starts and spans by their scope's end,
    and a span is kept when the furthest end among the parts passed reaches its scope's start.
    """
    passed = f"transform({parts}, p -> named_struct('at', p.start, 'turn', 0, 'reach', p.end, 'span', p))"
    asked = f"transform(own, p -> named_struct('at', p.end + {SCOPE}, 'turn', 1, 'reach', p.start - {SCOPE}, 'span', p))"
    none = -SCOPE - 1  # before any scope
    far = arrays.running(f"array_sort(concat({passed}, {asked}))", f"STRUCT<at: INT, turn: INT, reach: INT, span: {_SPAN}>", lambda x: f"IF({x}.turn = 0, {x}.reach, {none})", lambda a, b: f"greatest({a}, {b})", none)
    met = f"transform(filter({far}, e -> e.item.turn = 1 AND e.before >= e.item.reach), e -> e.item.span)"
    return arrays.let("own", spans, f"CASE WHEN size(own) > 0 AND size({parts}) > 0 THEN {met} ELSE {_NONE} END")


def _linked(kind: str, role: str) -> Column:
    """The kind's spans that have every complementary role in scope."""
    spans = f"at_{kind}"
    for wanted in COMPLEMENTS[role]:
        spans = _in_scope(spans, f"part_{wanted}")
    return F.expr(spans)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    at = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    at = at.select("doc_id", *[_positions(kind, pattern, least, most).alias(f"at_{kind}") for kind, _, _, pattern, least, most in KINDS])
    roles = {role: [k[0] for k in KINDS if k[1] == role] for role in ("identifier", "secret")}
    at = at.select("*", *[F.concat(*[F.col(f"at_{kind}") for kind in kinds]).alias(f"part_{role}") for role, kinds in roles.items()])
    base = [F.col(f"at_{kind}") for kind, _, weak, *_ in KINDS if not weak]
    at = at.select("*", F.concat(*base).alias("base"), F.concat(*[_linked(kind, role) for kind, role, weak, *_ in KINDS if weak]).alias("weak"))
    return at.select(
        "doc_id",
        *[F.size(f"at_{kind}").cast("long").alias(f"n_{kind}") for kind, _, weak, *_ in KINDS if not weak],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "weak")).alias("spans"),
    )


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    split = ", ".join(f"string_split_regex(text, {quote(p)}) AS p_{k}, regexp_extract_all(text, {quote(p)}) AS m_{k}" for k, _, _, p, *_ in KINDS)
    sums = "coalesce(list_sum(list_transform({0}[1:{1}], lambda z: length(z))), 0)"
    spans = []
    for rank, (kind, _, _, pattern, least, most) in enumerate(KINDS):
        start = f"{sums.format(f'p_{kind}', 'i')} + {sums.format(f'm_{kind}', 'i - 1')}"
        value = f"length(regexp_extract(m_{kind}[i], {quote(pattern)}, 2))" if least else "0"
        spans.append(
            f"list_filter(list_transform(range(1, len(m_{kind}) + 1), lambda i: {{'s': CAST({start} AS BIGINT), 'r': {rank}, 'e': CAST({start} + length(m_{kind}[i]) AS BIGINT), 'k': {quote(kind)}, 'v': {value}}}), lambda x: x.v BETWEEN {least or 0} AND {most or 2**31 - 1}) AS at_{kind}"
        )
    of = lambda role: "list_concat(" + ", ".join(f"at_{k}" for k, r, *_ in KINDS if r == role) + ")"
    near = f"len(list_filter(part_{{0}}, lambda q: q.s <= x.e + {SCOPE} AND q.e >= x.s - {SCOPE})) > 0"
    linked = ", ".join(f"list_filter(at_{k}, lambda x: {' AND '.join(near.format(r) for r in COMPLEMENTS[role])})" for k, role, weak, *_ in KINDS if weak)
    base = "list_concat(" + ", ".join(f"at_{k}" for k, _, weak, *_ in KINDS if not weak) + ")"
    text = "coalesce(array_to_string(list_transform(list_sort({0}), lambda x: x.k || ':' || x.s || ':' || x.e), ','), '')"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT doc_id, {split} FROM docs),
placed AS (SELECT doc_id, {", ".join(spans)} FROM parts),
roles AS (SELECT *, {of("identifier")} AS part_identifier, {of("secret")} AS part_secret, {base} AS base FROM placed),
linked AS (SELECT *, list_concat(base, {linked}) AS everything FROM roles)
SELECT doc_id, CAST(len(at_assign) AS BIGINT) AS n_assign, CAST(len(at_access) AS BIGINT) AS n_access, CAST(len(at_hex) AS BIGINT) AS n_hex,
       sha256({text.format("base")}) AS base_sha256, {text.format("everything")} AS spans
FROM linked
"""


OP10_SQL = _sql()
