"""The file scanner without Spark: fixtures, property tests and odd inputs."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.functions import text as texts
from brindle.plans import fixtures
from brindle.scanner import code, data, detect, dictionary, items, markup, scan, shapes, shell, verdicts, words
from brindle.sources import options, signatures


def found(path, text):
    return [(path, f.rule_id, f.severity, f.name, f.assignment_type, f.kind, None if f.start is None else text.count("\n", 0, f.start) + 1) for f in scan.scan_text(path, text)[1]]


@pytest.mark.parametrize("path", [p for _, p, _ in fixtures.FILES])
def test_fixtures(path):
    text = next(t for _, p, t in fixtures.FILES if p == path)
    assert sorted(found(path, text), key=str) == sorted((f for f in fixtures.FOUND if f[0] == path), key=str)


@pytest.mark.parametrize("name,kind,weak,service", fixtures.NAMES)
def test_names(name, kind, weak, service):
    own = words.classify(name)
    assert (own and own.kind, own and own.weak, own.service[0] if own and own.service else None) == (kind, weak, service)


def test_words():
    assert words.name_words(" dbPassword2.API_keyID ") == ["db", "password", "2", "api", "key", "id"]
    assert words.name_words("a1b2c3") == ["a1b2c3"] and words.camel_words("ABCDef") == ["abc", "def"] and words.name_words("") == []
    assert words.compound("apikey") == ["api", "key"] and words.compound("monkey") == ["monkey"]
    assert words.is_password_name("db.pass") and not words.is_password_name("passwordHash") and not words.is_password_name("")


@pytest.mark.parametrize("value,test,holds", fixtures.VALUES)
def test_values(value, test, holds):
    assert bool(getattr(shapes, test)(value)) == holds


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="0123456789", min_size=12, max_size=18))
def test_luhn(digits):
    """Exactly one last digit makes a number right."""
    if digits[0] in "23456":
        assert sum(shapes.is_card(digits + d) or digits + d in shapes.values.TEST_CARDS for d in "0123456789") == 1


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_entropy_is_bounded(text):
    assert 0 <= shapes.entropy(text) <= 8


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80), st.lists(st.tuples(st.integers(0, 80), st.integers(0, 80)), max_size=5))
def test_masks_keep_offsets(text, regions):
    regions = [(min(a, b, len(text)), min(max(a, b), len(text))) for a, b in regions]
    for made in (items.mask(text, regions), items.unmask(text, regions)):
        assert len(made) == len(text) and [i for i, c in enumerate(made) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab\"'`=:,;(){}[]<>/*#$%@-\\\n =&!|x1", max_size=120), st.sampled_from([*code.LANGUAGES]))
def test_no_text_stops_a_language(text, language):
    for i in code.extract(language, text):
        assert 0 <= i.start <= i.end <= len(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab\"'`=:,;(){}[]<>/*#$%@-\\\n =&!|x1", max_size=120), st.sampled_from(["a.json", "a.yaml", "a.toml", "a.xml", "a.tf", "Dockerfile", "a.sql", "a.sh", "a.html", "a.vue", "a.svelte", "a.astro", "a.php", "a.blade.php", "a.ejs", "a.erb", "a.cshtml", "a.twig", "a.liquid", ".env", ".pgpass", "a.ipynb", "a.plist", "x"]))
def test_no_text_stops_a_format(text, path):
    scan.scan_text(path, text)


def test_value_classes():
    judge = verdicts.Judge("datadog/x.py", services=tuple(s for s in scan.services.SERVICES if s[0] == "datadog"))
    assert judge.named_value(words.classify("api_key"), "a" * 31 + "1").kind == "Service"
    assert judge.named_value(words.classify("password"), "${{ secrets.A }}") is None and judge.bare_value("two words") is None
    assert verdicts.Judge("x").named_value(words.classify("key"), "onetwothreefour") is None  # a weak name needs entropy
    known = verdicts.Judge("x", known=frozenset(["purple", "monkey", "dishwasher"]))
    assert known.bare_value("purpleMonkeyDishwasher") is None and verdicts.Judge("x").bare_value("purpleMonkeyDishwasher").kind == "Possible"
    own = dictionary.Dictionary(frozenset(["administrator"]))
    assert own.long_word("xadministratorx") and not own.long_word("x" * 40 + "administrator") and own.run_together("administratorx") and not own.run_together("administrator1")


def test_mnemonics():
    listed = tuple(f"w{i:04d}" for i in range(2048))
    right = [p for p in (" ".join(["w0000"] * 11 + [w]) for w in listed) if shapes.is_mnemonic(p, listed)]
    assert len(right) == 128 and not shapes.is_mnemonic(right[0] + " w0000", listed) and not shapes.is_mnemonic(right[0], ())


def test_routing():
    assert scan.scan_text("a.py", "\npassword = 1", mode="compat") == (None, []) and scan.resolved_type("run", "#!/usr/bin/python3\n") == "Python"
    assert scan.scan_bytes("a", b"\xff\xfe") == (None, []) and scan.scan_bytes("a.kdb", bytes.fromhex("03d9a29a65fb4bb500000000"))[1][0].rule_id == "binary-secret"
    assert scan.scan_bytes("a.env", f"0={fixtures.A}".encode(), mode="compat") == (None, []) and scan.file_type("x.unknown") is None and scan.file_type("Makefile") == "Ini"
    assert found("a.py", f'password = "{fixtures.A}"\n# brindle:skip\nif x:\n  token = "{fixtures.B}"\napi_key = "{fixtures.B}"')[1][3] == "api_key"


def test_supersession_by_brute_force():
    r = random.Random(9)
    for _ in range(200):
        made = [verdicts.Finding("r", r.choice(["critical", "warning"]), None, None, "k", "d", *sorted(r.sample(range(12), 2)), str(i), r.random() < 0.5) for i in range(r.randint(0, 8))]
        lost = lambda f: any(f.from_content_scan and not o.from_content_scan and o.start < f.end and f.start < o.end or o.severity == "critical" != f.severity and o.start <= f.start and f.end <= o.end and (o.start, o.end) != (f.start, f.end) for o in made)  # noqa: E731, B023
        assert scan.superseded(made) == [f for f in made if not lost(f)]
        first = [f for i, f in enumerate(made) if not any(o.start <= f.start and f.end <= o.end for o in made[:i])]
        assert scan._without_repeats(made) == first


def shortest(tree, r):
    """A short match of a parsed pattern."""
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            kind, value = r.choice([a for a in arg if str(a[0]) != "NEGATE"])
            out += chr(value) if str(kind) == "LITERAL" else chr(r.randint(*value)) if str(kind) == "RANGE" else "7" if "DIGIT" in str(value) else "a"
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(shortest(arg[2], r) for _ in range(arg[0]))
        elif name == "SUBPATTERN":
            out += shortest(arg[3], r)
        elif name == "BRANCH":
            out += shortest(r.choice(arg[1]), r)
        elif name == "NOT_LITERAL" or name == "ANY":
            out += "z"
    return out


def test_the_automaton_finds_shortest_matches_of_every_signature():
    r, own, met = random.Random(11), signatures.matcher(), 0
    assert sum(not signatures.required(p) for _, _, p in signatures.SIGNATURES) <= 3
    for i, (_, _, pattern) in enumerate(signatures.SIGNATURES):
        for _ in range(20):
            text = shortest(re._parser.parse(pattern, re.ASCII), r)
            if own.compiled[i].search(text):
                met += 1
                assert i in own.candidates(text) and own.first(text) <= i and own.hits(f". {text} .")
    assert met > 2000


def test_data_formats():
    assert data.json("[1, 2") is None and data.json("") is None and data.json("{broken}") is None
    assert data.substituted("${A:-x}${B:+y}$C", {"B": "1", "C": "${B}"}) == "xy1" and data.substituted("$A", {"A": "$A"}) == "$A"
    assert [i.value for i in data.sql("SELECT $t$ a := 'x' $t$")] == ["x"] and data.dockerfile("nothing here\n") is None
    assert data.notebook("{}") is None and [i.name for i in data.plist(None, __import__("plistlib").dumps({"k": {"t": "v"}}, fmt=__import__("plistlib").FMT_BINARY))] == ["t"]
    assert shell.invocations("A=1 curl -H 'x y' | grep z") == [("curl", ["-H", "x y"]), ("grep", ["z"])]
    assert [i.value for i in code.extract("JavaScript", 'f("a" + "b", `c${d}`)')] == ["ab", "c${d}"]
    assert [(i.name, i.value) for i in code.extract("Python", "def f(a, b): pass\ndef f(c, d): pass\nf('x', 'y')") if i.kind == "assignment"] == [("c", "x"), ("d", "y")]
    assert markup.html("") == [] and [i.name for i in markup.html("<a x=1 y='2'>")] == ["x", "y"]


def test_configuration_lines():
    line = lambda t, k="Ini": [(i.name, i.assignment_type, i.value, t[i.start : i.end]) for i in data.config(t, k)]
    assert line("a\\=b = 'c # d' ") == [("a\\=b", "Property", "c # d", "'c # d'")] and line("export A=b#c #d", "DotEnv") == [("A", "EnvironmentVariable", "b#c", "b#c")]
    assert line("k: v = w", "Npmrc") == [("k: v", "Property", "w", "w")] and line("k = x\\\n   y") == [("k", "Property", "xy", "k = x\\\n   y")] and line("k = ''") == [] and line("root:x") == [("root", "Property", "x", "x")]


def test_base64_gate():
    secret = fixtures.NPM
    at = lambda t: (t, t.index(secret), t.index(secret) + len(secret))
    assert detect.in_base64(*at(f"x+{secret}")) and not detect.in_base64(*at(f"x {secret} y")) and not detect.in_base64(*at(f"https://h/{secret}/x")) and detect.in_base64(*at(f"{secret}/x"))


def test_options_in_layers():
    made = options.Layers(rc={"": {"deep": True, "skip-file-names": ["a"], "verbose": "no"}, "x": {"deep": "history-only", "skip-file-names": ["b"]}}, given={"show-summary": False})
    own = made.at("x/y/z.py")
    assert (own.deep, own.skip_file_names, own.show_summary, own.verbose) == ("history-only", (("", "a"), ("x", "b")), False, False)
    assert made.at("w").scans_tree and made.at("w").scans_history and not own.scans_tree and made.reason("q/b") is None and made.reason("x/b") == "file name"
    assert options.ancestors("/a/b/c") == ["", "/a", "/a/b"] and options.ancestors("a/b") == ["", "a"]


def test_texts():
    assert texts.wrapped("aa bb  cc ddddd", 5) == ["aa bb", "cc", "ddddd"]
    parts = [("strong", "a"), ("text", " b"), ("item", "c"), ("break", ""), ("code", "d")]
    assert texts.rendered(parts, "markdown") == "**a** b\n- c\n`d`" and texts.rendered(parts) == "a b\n* c\nd"
    assert texts.find_all({"a": [{"b": 1}, {"b": 2}, {"c": 3}]}, ["a", texts.ANY, "b"]) == [1, 2]
