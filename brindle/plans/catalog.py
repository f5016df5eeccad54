"""Every query of the scanning engine, with its SQL twin where SQL can express it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import names, text, values
from brindle.operators import extract, files_scan, scan, spans
from brindle.plans import fixtures, reports
from brindle.scanner import detect, dictionary, shapes, shell, verdicts, words
from brindle.sources import files, history, options, providers, services, signatures
from brindle.streaming import watch


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_assignments(spark, sf_dir):
    return scan.assignments(_read(spark, sf_dir, "documents"))


def scan_documents(spark, sf_dir):
    return scan.assignment_findings(document_assignments(spark, sf_dir)).drop("value")


def document_findings(spark, sf_dir):
    """The findings report over documents: assignments and payment card numbers."""
    cards = document_cards(spark, sf_dir).select("id", F.lit("secret-value").alias("rule_id"), F.lit("warning").alias("severity"), F.lit("CreditCard").alias("kind"), "start")
    return scan_documents(spark, sf_dir).select("id", "rule_id", "severity", "kind", "start").unionByName(cards)


def scan_summary(spark, sf_dir):
    return reports.summary(scan_documents(spark, sf_dir))


def findings_rollup(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return scan_documents(spark, sf_dir).join(docs, "id").rollup("source", "kind").agg(F.count(F.lit(1)).alias("n"))


def document_cards(spark, sf_dir):
    return scan.cards(_read(spark, sf_dir, "documents"), "doc_id", "text")


def page_cards(spark, sf_dir):
    return scan.cards(_read(spark, sf_dir, "pages"), "page_id", "html")


def document_signatures(spark, sf_dir):
    return spans.signature_hits(_read(spark, sf_dir, "documents"), "doc_id", "text").select("id", "ordinal")


def page_attributes(spark, sf_dir):
    found = _read(spark, sf_dir, "pages").select("page_id", F.explode(spans.matches("html", ATTRIBUTE)).alias("m"))
    return found.select("page_id", F.lower(F.regexp_extract("m.match", ATTRIBUTE, 1)).alias("name"), F.regexp_extract("m.match", ATTRIBUTE, 2).alias("value"), F.col("m.start").alias("start"))


def page_urls(spark, sf_dir):
    part = lambda i: F.regexp_extract("url", URL, i)
    return _read(spark, sf_dir, "pages").select("page_id", F.lower(part(1)).alias("scheme"), part(2).alias("userinfo"), F.lower(part(3)).alias("host"), part(4).alias("query"))


def value_shapes(spark, sf_dir):
    words_ = _read(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[ \t\n\r\f]+")).alias("word")).where("word <> ''").distinct()
    # One alternation finds the few words with any shape; each shape is tested on those alone.
    any_shape = "|".join(f"(?:{p})" for p in values.SHAPES.values())
    shaped = words_.select(values.normalized(F.col("word")).alias("word")).distinct().where(F.col("word").rlike(any_shape))
    return shaped.select("word", *values.shapes(F.col("word")))


def value_entropy(spark, sf_dir):
    value = values.normalized(F.col("value"))
    return document_assignments(spark, sf_dir).select(value.alias("value")).distinct().select("value", F.round(values.entropy(F.col("value")), 6).alias("bits"), values.alphabet_size(F.col("value")).cast("long").alias("alphabet"))


def name_words(spark, sf_dir):
    words = names.name_words(F.col("p_name"))
    return _read(spark, sf_dir, "part").select("p_partkey", F.array_join(words, " ").alias("words"), F.coalesce(names.name_kind(words), F.lit("none")).alias("kind"))


def event_bursts(spark, sf_dir):
    found = watch.debounced(_read(spark, sf_dir, "events"), "user_id", "ts", "5 minutes")
    return found.select("user_id", F.unix_micros(F.col("first").cast("timestamp")).alias("first"), F.unix_micros(F.col("last").cast("timestamp")).alias("last"), "n")


def event_properties(spark, sf_dir):
    return _read(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


def unlisted_documents(spark, sf_dir):
    listed = _read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return _read(spark, sf_dir, "documents").join(listed, "doc_id", "left_anti").select("doc_id", "source")


def git_blob_ids(spark, sf_dir):
    raw = F.col("text").cast("binary")
    return _read(spark, sf_dir, "documents").select("doc_id", F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(raw).cast("string")).cast("binary"), F.unhex(F.lit("00")), raw)).alias("oid"))


def line_counts(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.array_max(F.transform(F.split("text", "\n"), F.char_length)).cast("long").alias("longest"))


def url_file_types(spark, sf_dir):
    path = F.regexp_extract("url", r"^[a-z]+://[^/]*(/[^?#]*)", 1)
    return _read(spark, sf_dir, "pages").select("page_id", F.coalesce(files.file_type(path), F.lit("none")).alias("file_type"), F.coalesce(files.skip_reason(path), F.lit("none")).alias("skipped"))


def document_config(spark, sf_dir):
    return extract.config(_read(spark, sf_dir, "documents"), "doc_id", "text")


def event_trees(spark, sf_dir):
    return extract.tree(_read(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_type", F.struct("event_type").alias("of"))).alias("body")), "json", "event_id", "body")


def service_mentions(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.explode(services.in_path(F.col("text"))).alias("keyword"))


def document_services(spark, sf_dir):
    return services.service_values(spark, document_assignments(spark, sf_dir)).groupBy("keyword", "exposure").agg(F.count(F.lit(1)).alias("n"))


def mention_providers(spark, sf_dir):
    return providers.with_provider(spark, service_mentions(spark, sf_dir), None, "keyword").groupBy("provider").agg(F.count(F.lit(1)).alias("n"))


def _fixture_files(spark, group: str | None = None) -> DataFrame:
    return spark.createDataFrame([(p, t) for g, p, t in fixtures.FILES if group in (None, g)], "path string, text string")


def _fixture_scan(group: str):
    """A query that scans a group of the authored files, with its expected rows."""

    def query(spark, sf_dir):
        found = files_scan.scan_files(_fixture_files(spark, group))
        return found.select("path", "rule_id", "severity", "name", "assignment_type", "kind", F.col("start_line").alias("line"))

    query.__name__ = f"scan_{group}_files"
    return query


def classify_names(spark, sf_dir):
    """Kind, weakness and service of names."""

    @F.pandas_udf("kind string, weak boolean, service string")
    def told(own):
        import pandas as pd

        found = [words.classify(n) for n in own]
        return pd.DataFrame({"kind": [f and f.kind for f in found], "weak": [f and f.weak for f in found], "service": [f.service[0] if f and f.service else None for f in found]})

    names_ = spark.createDataFrame([(n,) for n, *_ in fixtures.NAMES], "name string")
    return names_.select("name", told("name").alias("t")).select("name", "t.*")


def value_predicates(spark, sf_dir):
    """Each predicate over values, one that it holds for and one that it doesn't."""

    @F.pandas_udf("boolean")
    def holds(own, tests):
        return own.combine(tests, lambda v, t: bool(getattr(shapes, t)(v)))

    return spark.createDataFrame([(v, t) for v, t, _ in fixtures.VALUES], "value string, test string").select("value", "test", holds("value", "test").alias("holds"))


def severity_matrix(spark, sf_dir):
    """Severity of a named value by its name's kind and its own, and of a value in a header or in content."""
    kinds = ("Public", "Placeholder", "PrivateKey", "PuttyKey", "Signature", "Service", "Url", "CreditCard", "Mnemonic", "Possible")
    rows = [(n, k, p, verdicts.assignment_severity(n, k, p), verdicts.value_severity(k)) for n in (None, "Mnemonic", "Sensitive", "Key", "Token") for k in kinds for p in (False, True)]
    return spark.createDataFrame(rows, "name_kind string, value_kind string, password_field boolean, severity string, in_content string")


def binary_stores(spark, sf_dir):
    """Binary key stores by their first byte's detector."""

    @F.pandas_udf("string")
    def kind(own):
        return own.map(lambda raw: detect.binary(bytes(raw)))

    return spark.createDataFrame([(p, bytearray.fromhex(h)) for p, h, _ in fixtures.BINARIES], "path string, content binary").select("path", kind("content").alias("kind"))


def header_credentials(spark, sf_dir):
    """The credentials in headers."""

    @F.pandas_udf("array<string>")
    def held(own, text_):
        def one(name, value):
            lower = name.lower()
            if lower in ("cookie", "set-cookie"):
                return verdicts.cookie_values(value)
            if lower in ("authorization", "proxy-authorization"):
                return [c for c in [verdicts.authorization_credential(value)] if c]
            return [value] if lower in verdicts.SENSITIVE_HEADERS else []

        return own.combine(text_, one)

    return spark.createDataFrame([h[:2] for h in fixtures.HEADERS], "header string, value string").select("header", "value", F.array_join(held("header", "value"), ",").alias("credentials"))


def connection_strings(spark, sf_dir):
    """The credentials in connection strings."""
    rows = spark.createDataFrame([(c,) for c, _ in fixtures.CONNECTIONS], "value string")
    return rows.select("value", F.array_join(values.connection_credentials(F.col("value")), ",").alias("credentials"))


def url_secrets(spark, sf_dir):
    """What credentials URLs hold, and where."""

    @F.pandas_udf("detail string, location string, keys string")
    def told(own):
        import pandas as pd

        found = [verdicts.Judge().url(u) for u in own]
        return pd.DataFrame({"detail": [f and f.detail for f in found], "location": [f and f.location for f in found], "keys": [",".join(f.keys) if f else "" for f in found]})

    return spark.createDataFrame([(u,) for u, *_ in fixtures.URLS], "url string").select("url", told("url").alias("t")).select("url", "t.*")


def tree_reasons(spark, sf_dir):
    """Why files of a tree with rc and ignore files are skipped."""
    tree = spark.createDataFrame(list(fixtures.TREE), "path string, text string")
    return options.with_reason(tree, options.layers(tree)).select("path", F.col("skip_reason").alias("reason"))


def cutoff_times(spark, sf_dir):
    """The moments that cut-off texts stand for."""
    rows = spark.createDataFrame([(t,) for t, _ in fixtures.CUTOFFS], "value string")
    return rows.select("value", F.unix_seconds(history.cutoff(F.col("value"))).alias("seconds"))


def call_parameters(spark, sf_dir):
    """Arguments joined to the parameters of the last definition of what they call."""
    calls = spark.createDataFrame([(p, c, s, list(a)) for p, c, s, a in fixtures.CALLS], "path string, callee string, seq int, args array<string>")
    made = spark.createDataFrame([(p, c, s, list(a)) for p, c, s, a in fixtures.DEFINITIONS], "path string, name string, seq int, params array<string>")
    return spans.call_parameters(calls, made)


def superseded_spans(spark, sf_dir):
    """The findings of a file that no other one supersedes."""
    rows = spark.createDataFrame(list(fixtures.SPANS), "path string, finding int, severity string, from_content_scan boolean, start int, end int")
    return spans.without_superseded(rows).select("path", "finding")


def report_words(spark, sf_dir):
    """Articles and property accesses for messages."""
    a = spark.createDataFrame([(t,) for t, _ in fixtures.ARTICLES], "subject string").select("subject", text.article(F.col("subject")).alias("shown"))
    b = spark.createDataFrame([(o, n) for o, n, _ in fixtures.ACCESSES], "o string, n string").select(F.concat_ws(" ", "o", "n").alias("subject"), text.js_access(F.col("o"), F.col("n")).alias("shown"))
    return a.unionByName(b)


def blob_history(spark, sf_dir):
    """Attribution of blobs: users stand for blobs and events for commits."""
    kinds = F.element_at(F.array(*[F.lit(k) for k in history.PRIORITY]), (F.col("event_id") % len(history.PRIORITY) + 1).cast("int"))
    entries = _read(spark, sf_dir, "events").select(
        kinds.alias("ref_kind"), F.concat(F.lit("ref"), F.col("event_id") % 7).alias("ref"), F.col("event_id").cast("string").alias("commit"), F.col("ts").cast("timestamp").alias("author_ts"),
        F.lit("s").alias("subject"), F.concat(F.lit("dir/"), "event_type").alias("path"), F.col("user_id").cast("string").alias("oid"),
    )
    found = history.attributed(entries)
    return found.select("oid", "commit", "path", "author_date", F.col("location.ref_kind").alias("ref_kind"), F.element_at("commits", 1)["commit"].alias("oldest"), F.element_at("commits", -1)["commit"].alias("newest"), F.size("commits").cast("long").alias("total"))


def commit_ancestors(spark, sf_dir):
    """What commits reach over their parents: commit k has the parents k / 2 and k / 3."""
    parents = spark.range(1, 65).select(F.col("id").cast("string").alias("commit"), F.filter(F.array_distinct(F.array((F.col("id") / 2).cast("long").cast("string"), (F.col("id") / 3).cast("long").cast("string"))), lambda p: p != "0").alias("parents"))
    return history.ancestors(spark, parents, parents.where("CAST(commit AS INT) > 60"))


def nearest_roots(spark, sf_dir):
    """The longest root above each page's path."""
    path = F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1)
    pages = _read(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    roots = pages.select(F.regexp_extract("path", r"^([^/]*)", 1).alias("root")).union(pages.where("page_id % 3 = 0").select(F.regexp_extract("path", r"^([^/]*/[^/]*)/", 1).alias("root"))).where("root <> ''").distinct()
    return options.nearest_root(pages, roots).select("page_id", "root")


def changed_documents(spark, sf_dir):
    """Files that the incremental state doesn't know as clean: documents whose length was another before."""
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("modified"))
    state = _read(spark, sf_dir, "labels").join(docs.withColumnRenamed("path", "doc_id"), "doc_id").select(F.col("doc_id").alias("path"), "modified", (F.col("quality") == 1).alias("clean"))
    return spans.changed_files(docs, state).select("path")


def validation_statuses(spark, sf_dir):
    """Live, inactive and unknown by the answer's code; equal secrets are asked for once."""
    found = spark.createDataFrame([(1, "NPM access token", "a"), (2, "NPM access token", "a"), (3, "NPM access token", "a"), (4, "Stripe secret key", "b"), (5, "GitHub token", "c"), (6, "GitHub token", "d"), (7, "unheard of", "e")], "finding int, detail string, secret string")
    asked = providers.with_provider(spark, found)
    codes = spark.createDataFrame([("a", 200), ("b", 403), ("c", 500), ("d", 401)], "secret string, code int")
    answers = providers.requests(asked).join(F.broadcast(codes), "secret")
    return providers.with_status(spark, asked, answers).select("finding", "validation")


def _of_pairs(spark, rows, columns: str, test, kind: str = "boolean"):
    """``rows`` (two strings each) with what a Python function says of them."""

    @F.pandas_udf(kind)
    def told(a, b):
        return a.combine(b, test)

    first, second, name = columns.split()
    return spark.createDataFrame([r[:2] for r in rows], f"{first} string, {second} string").select(first, second, told(first, second).alias(name))


def path_rules(spark, sf_dir):
    """Why paths are skipped by names, globs, directories, metadata files and lock files."""
    rows = spark.createDataFrame([(p,) for p, _ in fixtures.PATHS], "path string")
    return rows.select("path", files.skip_reason(F.col("path"), ("secret.txt",), ("docs/**/*.md",), True).alias("reason"))


def glob_matches(spark, sf_dir):
    """Globs over paths, by the pattern that each becomes."""
    rows = [(g, p, files.glob_pattern(g)) for g, p, _ in fixtures.GLOBS]
    return spark.createDataFrame(rows, "glob string, path string, pattern string").select(F.col("glob").alias("rule"), "path", F.expr("path RLIKE pattern").alias("matches"))


def dictionary_verdicts(spark, sf_dir):
    """What known words say about values."""
    own = frozenset(fixtures.WORDS)

    def holds(value, test):
        words_ = dictionary.Dictionary(own)
        return getattr(words_, test)(value, value) if test == "identifier" else getattr(words_, test)(value)

    return _of_pairs(spark, fixtures.VERDICTS, "value test holds", holds)


def shell_commands(spark, sf_dir):
    """The simple commands of scripts."""
    rows = [(s, "") for s, _ in fixtures.COMMANDS]
    return _of_pairs(spark, rows, "script nothing commands", lambda s, _: ";".join("|".join([n, *a]) for n, a in shell.invocations(s)), "string").drop("nothing")


def tree_paths(spark, sf_dir):
    """The values of trees at paths."""
    return _of_pairs(spark, fixtures.TREES, "tree path found", lambda t, p: ",".join(str(v) for v in text.find_all(json.loads(t), [text.ANY if k == "*" else k for k in p.split(".")])), "string")


def rescanned_files(spark, sf_dir):
    """Whether files are scanned again after an ignore file and a file change."""
    tree = spark.createDataFrame([(p,) for p, _ in fixtures.AGAIN], "path string")
    again = watch.invalidated(spark.createDataFrame([(p,) for p in fixtures.CHANGED], "path string"), tree).withColumn("again", F.lit(True))
    return tree.join(again, "path", "left").select("path", F.coalesce("again", F.lit(False)).alias("again"))


def flagged_files(spark, sf_dir):
    """Whether each authored file has a finding: the incremental scan's state."""
    tree = _fixture_files(spark)
    return reports.flagged(files_scan.scan_files(tree), tree)


def report_documents(spark, sf_dir):
    """How many findings each kind of single document holds, read back from it."""
    found = files_scan.scan_files(_fixture_files(spark))
    counted = {
        "json": "size(from_json(d, 'diagnostics array<struct<ruleId string>>').diagnostics)", "sarif": "size(from_json(d, 'runs array<struct<results array<struct<ruleId string>>>>').runs[0].results)",
        "junit": "CAST(xpath_number(d, 'count(/testsuite/testcase/failure)') AS INT)", "xml": "CAST(xpath_number(d, 'count(/diagnostics/diagnostic/ruleId)') AS INT)",
    }
    made = None
    for kind, how in counted.items():  # the authored files have few findings, so a document fits in a row here
        one = reports.document(found, kind).agg(F.array_join(F.collect_list("value"), "\n").alias("d")).select(F.lit(kind).alias("kind"), F.expr(how).alias("findings"))
        made = one if made is None else made.unionByName(one)
    return made


def summary_line(spark, sf_dir):
    """The summary row of the authored files' scan, with its line."""
    tree = _fixture_files(spark)
    return reports.summary_row(files_scan.scan_files(tree), tree, 1500)


ATTRIBUTE = r"""([A-Za-z_:][A-Za-z0-9_:.-]*)[ \t\n]*=[ \t\n]*["']([^"']*)["']"""
URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:]*)[^?#]*(?:\?([^#]*))?"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        scan_documents, document_findings, document_assignments, scan_summary, findings_rollup, document_cards, page_cards, document_signatures, page_attributes, page_urls, value_shapes,
        value_entropy, name_words, event_bursts, event_properties, unlisted_documents, git_blob_ids, line_counts, url_file_types, document_config, event_trees,
        service_mentions, document_services, mention_providers, classify_names, value_predicates, severity_matrix, binary_stores, header_credentials, connection_strings, url_secrets, tree_reasons, cutoff_times,
        call_parameters, superseded_spans, report_words, blob_history, commit_ancestors, nearest_roots, changed_documents, validation_statuses, summary_line,
        path_rules, glob_matches, dictionary_verdicts, shell_commands, tree_paths, rescanned_files, flagged_files, report_documents,
        *[_fixture_scan(group) for group in ("code", "data", "markup", "schemas", "keys")],
    )
    return {f.__name__: f for f in found}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _matches_sql(table: str, key: str, text: str, pattern: str) -> str:
    """Rows (id, text, match, start) of all matches."""
    p = _q(pattern)
    sums = "coalesce(list_sum(list_transform({0}[1:{1}], lambda z: length(z))), 0)"
    return f"""(SELECT id, text, m[i] AS match, CAST({sums.format("g", "i")} + {sums.format("m", "i - 1")} AS INTEGER) AS start
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {key} AS id, {text} AS text, regexp_extract_all({text}, {p}) AS m, string_split_regex({text}, {p}) AS g FROM {table})))"""


def _values_sql(rows, columns: str) -> str:
    """A table of fixed rows. Columns are `name type`, parted by commas."""
    sql = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else _q(v)
    own = [c.split() for c in columns.split(", ")]
    body = ", ".join("(" + ", ".join(map(sql, row)) + ")" for row in rows)
    return f"SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in own)} FROM (VALUES {body}) AS v({', '.join(n for n, _ in own)})"


def _url_types_sql() -> str:
    listed = lambda xs: "(" + ", ".join(map(_q, xs)) + ")"
    exact = " ".join(f"WHEN name = {_q(n)} THEN {_q(t)}" for n, t in files.BY_NAME.items())
    stems = " ".join(f"WHEN name = '{s}' OR starts_with(name, '{s}.') OR ends_with(name, '.{s}') THEN '{t}'" for s, t in (("dockerfile", "Dockerfile"), ("jenkinsfile", "Groovy")))
    by_extension = " ".join(f"WHEN extension IN {listed(x.split())} THEN {_q(t)}" for t, x in files.BY_EXTENSION.items())
    return f"""SELECT page_id, CASE WHEN name = '.env' OR starts_with(name, '.env.') THEN 'DotEnv' {exact} {stems} WHEN regexp_matches(name, '^(redis|sentinel)(-.*)?\\.conf$') THEN 'Redis'
        WHEN ends_with(name, '.blade.php') THEN 'Blade' {by_extension} WHEN extension = '' THEN 'Ini' ELSE 'none' END AS file_type,
        CASE WHEN list_has_any(parts[1:len(parts) - 1], [{", ".join(map(_q, files.SKIPPED_DIRS))}]) THEN 'directory' WHEN parts[-1] IN {listed(files.METADATA_FILES)} THEN 'metadata' ELSE 'none' END AS skipped
        FROM (SELECT *, regexp_extract(name, '^.+\\.([^.]*)$', 1) AS extension FROM (SELECT *, lower(parts[-1]) AS name FROM (
          SELECT page_id, string_split(regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1), '/') AS parts FROM pages)))"""


def _expected_sql() -> dict[str, str]:
    """What the authored fixtures give, and the SQL of relational operators over them."""
    groups = {p: g for g, p, _ in fixtures.FILES}
    finding = "path VARCHAR, rule_id VARCHAR, severity VARCHAR, name VARCHAR, assignment_type VARCHAR, kind VARCHAR, line INTEGER"
    kind = "CASE WHEN value_kind IN ('Public', 'Placeholder') THEN NULL WHEN value_kind IN ('PrivateKey', 'PuttyKey', 'Signature', 'CreditCard') THEN 'critical' WHEN value_kind IN ('Service', 'Url') THEN 'warning' WHEN name_kind = 'Mnemonic' THEN CASE WHEN value_kind = 'Mnemonic' THEN 'warning' END WHEN name_kind IS NOT NULL OR password_field THEN 'warning' END"
    statuses = {1: "live", 2: "live", 3: "live", 4: "live", 5: "unknown", 6: "inactive", 7: None}
    n_critical, n = sum(f[2] == "critical" for f in fixtures.FOUND), len(fixtures.FOUND)
    lists = lambda xs: "[" + ", ".join(map(_q, xs)) + "]"
    table = lambda rows, names_: f"(SELECT * FROM (VALUES {', '.join(rows)}) AS v({names_}))"
    calls = table([f"({_q(p)}, {_q(c)}, {s}, {lists(a)})" for p, c, s, a in fixtures.CALLS], "path, callee, seq, args")
    made = table([f"({_q(p)}, {_q(c)}, {s}, {lists(a)})" for p, c, s, a in fixtures.DEFINITIONS], "path, callee, seq, params")
    spans_ = table([f"({_q(p)}, {i}, {_q(s)}, {c}, {a}, {b})" for p, i, s, c, a, b in fixtures.SPANS], 'path, finding, severity, content, a, b')
    rank = "list_position(['dangling', 'stash', 'tag', 'remoteRef', 'branch', 'current branch'], ref_kind)"
    return {
        **{f"scan_{g}_files": _values_sql([f for f in fixtures.FOUND if groups[f[0]] == g], finding) for g in ("code", "data", "markup", "schemas", "keys")},
        "classify_names": _values_sql(fixtures.NAMES, "name VARCHAR, kind VARCHAR, weak BOOLEAN, service VARCHAR"),
        "value_predicates": _values_sql(fixtures.VALUES, "value VARCHAR, test VARCHAR, holds BOOLEAN"),
        "severity_matrix": f"""SELECT name_kind, value_kind, password_field, {kind} AS severity,
            CASE WHEN value_kind IN ('Public', 'Placeholder') THEN NULL WHEN value_kind IN ('PrivateKey', 'PuttyKey', 'Signature') THEN 'critical' ELSE 'warning' END AS in_content
            FROM (SELECT unnest([NULL, 'Mnemonic', 'Sensitive', 'Key', 'Token']) AS name_kind), (SELECT unnest(['Public', 'Placeholder', 'PrivateKey', 'PuttyKey', 'Signature', 'Service', 'Url', 'CreditCard', 'Mnemonic', 'Possible']) AS value_kind), (SELECT unnest([false, true]) AS password_field)""",
        "binary_stores": _values_sql([(p, k) for p, _, k in fixtures.BINARIES], "path VARCHAR, kind VARCHAR"),
        "header_credentials": _values_sql([(h, v, ",".join(c)) for h, v, c in fixtures.HEADERS], "header VARCHAR, value VARCHAR, credentials VARCHAR"),
        "connection_strings": _values_sql([(v, ",".join(c)) for v, c in fixtures.CONNECTIONS], "value VARCHAR, credentials VARCHAR"),
        "url_secrets": _values_sql(fixtures.URLS, "url VARCHAR, detail VARCHAR, location VARCHAR, keys VARCHAR"),
        "tree_reasons": _values_sql(fixtures.REASONS, "path VARCHAR, reason VARCHAR"),
        "cutoff_times": _values_sql(fixtures.CUTOFFS, "value VARCHAR, seconds BIGINT"),
        "report_words": _values_sql([*fixtures.ARTICLES, *[(f"{o} {n_}", s) for o, n_, s in fixtures.ACCESSES]], "subject VARCHAR, shown VARCHAR"),
        "validation_statuses": _values_sql(statuses.items(), "finding INTEGER, validation VARCHAR"),
        "path_rules": _values_sql(fixtures.PATHS, "path VARCHAR, reason VARCHAR"),
        "glob_matches": _values_sql(fixtures.GLOBS, "rule VARCHAR, path VARCHAR, matches BOOLEAN"),
        "dictionary_verdicts": _values_sql(fixtures.VERDICTS, "value VARCHAR, test VARCHAR, holds BOOLEAN"),
        "shell_commands": _values_sql(fixtures.COMMANDS, "script VARCHAR, commands VARCHAR"),
        "tree_paths": _values_sql(fixtures.TREES, "tree VARCHAR, path VARCHAR, found VARCHAR"),
        "rescanned_files": _values_sql(fixtures.AGAIN, "path VARCHAR, again BOOLEAN"),
        "flagged_files": _values_sql([(p, p in {f[0] for f in fixtures.FOUND}) for _, p, _ in fixtures.FILES], "path VARCHAR, found BOOLEAN"),
        "report_documents": _values_sql([(k, n) for k in ("json", "sarif", "junit", "xml")], "kind VARCHAR, findings INTEGER"),
        "summary_line": _values_sql([(len(fixtures.FILES), 1500, n_critical, n - n_critical, n, f"Scanned {len(fixtures.FILES)} files in 1.50s. Found {n_critical} secrets and {n - n_critical} warnings.")], "scanned_files BIGINT, elapsed_ms BIGINT, critical BIGINT, warning BIGINT, total BIGINT, message VARCHAR"),
        "call_parameters": f"""SELECT path, callee, seq, CAST(i - 1 AS INTEGER) AS position, params[i] AS parameter, args[i] AS argument FROM (
            SELECT c.path, c.callee, c.seq, args, params, unnest(range(1, least(len(args), len(params)) + 1)) AS i
            FROM {calls} c JOIN (SELECT path, callee, arg_max(params, seq) AS params FROM {made} GROUP BY ALL) d ON c.path = d.path AND c.callee = d.callee)""",
        "superseded_spans": f"""SELECT path, finding FROM {spans_} f WHERE NOT EXISTS (SELECT 1 FROM {spans_} o WHERE o.path = f.path AND (
            f.content AND NOT o.content AND o.a < f.b AND f.a < o.b OR o.severity = 'critical' AND f.severity = 'warning' AND o.a <= f.a AND f.b <= o.b AND (o.a <> f.a OR o.b <> f.b)))""",
        "blob_history": f"""WITH e AS (SELECT ['current branch', 'branch', 'remoteRef', 'tag', 'stash', 'dangling'][event_id % 6 + 1] AS ref_kind, 'ref' || (event_id % 7) AS ref, CAST(event_id AS VARCHAR) AS commit, ts, 'dir/' || event_type AS path, CAST(user_id AS VARCHAR) AS oid FROM events)
            SELECT oid, arg_min(commit, (ts, commit)) AS commit, arg_min(path, (ts, commit)) AS path, CAST(min(ts) AS DATE) AS author_date, arg_max(ref_kind, ({rank}, ref)) AS ref_kind, arg_min(commit, (ts, commit)) AS oldest, arg_max(commit, (ts, commit)) AS newest, count(*) AS total FROM e GROUP BY oid""",
        "commit_ancestors": """WITH RECURSIVE p AS (SELECT i AS c, unnest(list_distinct([i // 2, i // 3])) AS up FROM range(1, 65) t(i)), reach AS (
            SELECT i AS tip, i AS c FROM range(61, 65) t(i) UNION SELECT tip, up FROM reach JOIN p USING (c) WHERE up > 0)
            SELECT DISTINCT CAST(tip AS VARCHAR) AS tip, CAST(c AS VARCHAR) AS commit FROM reach""",
        "nearest_roots": """WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path FROM pages), r AS (
            SELECT regexp_extract(path, '^([^/]*)', 1) AS root FROM p UNION SELECT regexp_extract(path, '^([^/]*/[^/]*)/', 1) FROM p WHERE page_id % 3 = 0)
            SELECT page_id, arg_max(root, length(root)) AS root FROM p LEFT JOIN r ON root <> '' AND (path = root OR starts_with(path, root || '/')) GROUP BY page_id""",
        "changed_documents": "SELECT doc_id AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
        "url_file_types": _url_types_sql(),
        "git_blob_ids": "SELECT doc_id, sha1('blob ' || octet_length(encode(text)) || chr(0) || text) AS oid FROM documents",
    }


def _normal_sql(value: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"translate(regexp_replace({value}, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g'), '{upper}', '{upper.lower()}')"


def _entropy_sql(v: str) -> str:
    chars = f"list_filter(string_split({v}, ''), lambda c: c <> '')"
    share = f"(len(list_filter({chars}, lambda d: d = c)) / len({chars}))"
    return f"coalesce(list_sum(list_transform(list_sort(list_distinct({chars})), lambda c: -{share} * log2({share}))), 0.0)"


def _alphabet_sql(v: str) -> str:
    return f"(CASE WHEN regexp_matches({v}, '[a-z]') THEN 26 ELSE 0 END + CASE WHEN regexp_matches({v}, '[0-9]') THEN 10 ELSE 0 END + len(list_distinct(list_filter(string_split({v}, ''), lambda c: c <> '' AND NOT regexp_matches(c, '[0-9a-z]')))))"


def oracle_sql() -> dict[str, str]:
    parts = _q(scan._PARTS)
    before = "substr(text, 1, start)"
    assigned = f"""SELECT id, regexp_extract(match, {parts}, 1) AS name, regexp_extract(match, {parts}, 2) AS value, start, CAST(length(match) AS INTEGER) AS length,
      CAST(length({before}) - length(replace({before}, chr(10), '')) + 1 AS INTEGER) AS line, CAST(length(string_split({before}, chr(10))[-1]) + 1 AS INTEGER) AS "column"
      FROM {_matches_sql("documents", "doc_id", "text", scan.ASSIGNMENT)}"""
    out = " OR ".join(f"regexp_matches(v, {_q(p)})" for n, p in values.SHAPES.items() if n != "pure_hex")
    enough = f"""(regexp_matches(v, {_q(values.SHAPES["pure_hex"])}) OR (length(v) >= 8 AND bits * length(v) >= 40 AND (bits >= 3.5 OR bits / log2(greatest({_alphabet_sql("v")}, 2)) >= 0.85)))"""
    findings = f"""SELECT id, name, kind, start, line, "column", 'secret-assignment' AS rule_id, 'warning' AS severity, 'Secret assigned to ' || name AS message
      FROM (SELECT *, {_entropy_sql("v")} AS bits, {names.kind_sql("w")} AS kind FROM (SELECT *, {_normal_sql("value")} AS v, {names.words_sql("name")} AS w FROM ({assigned})))
      WHERE kind IS NOT NULL AND length(v) >= 8 AND NOT ({out}) AND {enough}"""
    luhn = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(d[i] AS INTEGER) WHEN CAST(d[i] AS INTEGER) > 4 THEN CAST(d[i] AS INTEGER) * 2 - 9 ELSE CAST(d[i] AS INTEGER) * 2 END)) % 10 = 0"
    tested = ", ".join(map(_q, values.TEST_CARDS))
    cards = lambda t, k, x: f"SELECT id, start, CAST(length(d) AS INTEGER) AS n_digits FROM (SELECT *, regexp_replace(match, '[ -]', '', 'g') AS d FROM {_matches_sql(t, k, x, scan.CARD)}) WHERE regexp_matches(d, '^[2-6][0-9]{{12,18}}$') AND d NOT IN ({tested}) AND {luhn}"
    attribute, url = _q(ATTRIBUTE), _q(URL)
    shapes = ", ".join(f"regexp_matches(word, {_q(p)}) AS {n}" for n, p in values.SHAPES.items())
    listed = " UNION ALL ".join(f"SELECT CAST(doc_id AS VARCHAR) AS id, {i} AS ordinal FROM documents WHERE regexp_matches(text, {_q(p)})" for i, (_, _, p) in enumerate(signatures.SIGNATURES))
    keywords = "[" + ", ".join(_q(k) for k, *_ in services.SERVICES) + "]"
    mentions = f"SELECT doc_id, unnest(list_filter({keywords}, lambda k: contains(lower(text), k))) AS keyword FROM documents"
    held = " UNION ALL ".join(f"SELECT {_q(k)} AS keyword, {_q('|'.join(p))} AS secret, {_q('|'.join(u))} AS shown" for k, _, _, p, u in services.SERVICES)
    provided = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in providers.BY_SERVICE.items())
    return {
        **_expected_sql(),
        "service_mentions": mentions,
        "mention_providers": f"SELECT CASE keyword {provided} END AS provider, count(*) AS n FROM ({mentions}) GROUP BY 1",
        "document_services": f"""SELECT keyword, CASE WHEN regexp_matches(v, secret) THEN 'secret' ELSE 'public' END AS exposure, count(*) AS n
            FROM (SELECT {_normal_sql("value")} AS v, unnest(list_distinct({names.words_sql("name")})) AS keyword FROM ({assigned})) JOIN ({held}) USING (keyword)
            WHERE regexp_matches(v, secret) OR (shown <> '' AND regexp_matches(v, shown)) GROUP BY ALL""",
        "document_assignments": assigned,
        "scan_documents": findings,
        "document_findings": f"""SELECT id, rule_id, severity, kind, start FROM ({findings}) UNION ALL SELECT id, 'secret-value', 'warning', 'CreditCard', start FROM ({cards("documents", "doc_id", "text")})""",
        "scan_summary": f"SELECT CAST(count_if(severity = 'critical') AS BIGINT) AS critical, CAST(count_if(severity = 'warning') AS BIGINT) AS warning, count(*) AS total FROM ({findings})",
        "findings_rollup": f"SELECT source, kind, count(*) AS n FROM ({findings}) f JOIN documents d ON d.doc_id = f.id GROUP BY ROLLUP (source, kind)",
        "document_cards": cards("documents", "doc_id", "text"),
        "page_cards": cards("pages", "page_id", "html"),
        "document_signatures": listed,
        "page_attributes": f"SELECT id AS page_id, lower(regexp_extract(match, {attribute}, 1)) AS name, regexp_extract(match, {attribute}, 2) AS value, start FROM {_matches_sql('pages', 'page_id', 'html', ATTRIBUTE)}",
        "page_urls": f"SELECT page_id, lower(regexp_extract(url, {url}, 1)) AS scheme, regexp_extract(url, {url}, 2) AS userinfo, lower(regexp_extract(url, {url}, 3)) AS host, regexp_extract(url, {url}, 4) AS query FROM pages",
        "value_shapes": f"SELECT * FROM (SELECT word, {shapes} FROM (SELECT DISTINCT {_normal_sql('word')} AS word FROM (SELECT unnest(string_split_regex(text, '[ \\t\\n\\r\\f]+')) AS word FROM documents) WHERE word <> '')) WHERE {' OR '.join(values.SHAPES)}",
        "value_entropy": f"SELECT value, round({_entropy_sql('value')}, 6) AS bits, CAST({_alphabet_sql('value')} AS BIGINT) AS alphabet FROM (SELECT DISTINCT {_normal_sql('value')} AS value FROM ({assigned}))",
        "name_words": f"SELECT p_partkey, array_to_string(w, ' ') AS words, coalesce({names.kind_sql('w')}, 'none') AS kind FROM (SELECT p_partkey, {names.words_sql('p_name')} AS w FROM part)",
        "event_bursts": """SELECT user_id, epoch_us(min(ts)) AS "first", epoch_us(max(ts)) AS "last", count(*) AS n FROM (
            SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM (
              SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, burst""",
        "document_config": f"""SELECT id, line, regexp_extract(body, {_q(extract.CONFIG)}, 1) AS name, concat(regexp_extract(body, {_q(extract.CONFIG)}, 2), regexp_extract(body, {_q(extract.CONFIG)}, 3), regexp_extract(body, {_q(extract.CONFIG)}, 4)) AS value
            FROM (SELECT id, CAST(i AS INTEGER) AS line, l[i] AS body FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id AS id, string_split(regexp_replace(text, {_q(extract.CONTINUED)}, '', 'g'), chr(10)) AS l FROM documents)))
            WHERE regexp_matches(body, {_q(extract.CONFIG)}) AND value <> ''""",
        "event_trees": "SELECT event_id AS id, unnest(['event_type', 'of.event_type']) AS name, event_type AS value FROM events",
        "event_properties": "SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL",
        "unlisted_documents": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
        "line_counts": "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, CAST(list_max(list_transform(string_split(text, chr(10)), lambda l: length(l))) AS BIGINT) AS longest FROM documents",
    }
