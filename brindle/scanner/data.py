"""Extraction from data and configuration formats, with places.

A text that isn't of its format gives None (not parsed); configuration lines and YAML never fail.
"""

from __future__ import annotations

import base64
import plistlib
import re
from collections.abc import Callable
from xml.parsers import expat

from brindle.scanner import code, shell
from brindle.scanner.items import Item, shifted

Hook = Callable[[tuple[str, ...], str], bool]


def _lines(text: str):
    at = 0
    for line in text.split("\n"):
        yield at, line.rstrip("\r")
        at += len(line) + 1


def config(text: str, file_type: str = "Ini") -> list[Item]:
    """`name = value` and `name: value` lines; .npmrc has `=` only. A line with an odd number of backslashes at its end goes on.

    The separator is the first that no backslash precedes. A value that no quote begins ends at a comment sign after white space.
    """
    kind = {"DotEnv": "EnvironmentVariable", "FlaskEnv": "EnvironmentVariable", "UserDatabase": "User"}.get(file_type, "Property")
    separators = "=" if file_type == "Npmrc" else "=:"
    found, held, begin = [], "", None
    for at, line in _lines(text):
        begin = at if begin is None else begin
        if len(line) - len(line.rstrip("\\")) & 1:
            held += line[:-1] if not held else line[:-1].lstrip()
            continue
        found += _config_line(held + line.lstrip(), begin, at + len(line), kind, separators, True) if held else _config_line(line, at, at + len(line), kind, separators, False)
        held, begin = "", None
    return found


def _config_line(line: str, start: int, end: int, kind: str, separators: str, joined: bool) -> list[Item]:
    own = line.lstrip()
    if not own or own[0] in "#!;[":
        return []
    own = re.sub(r"^export[ \t]", "", own)
    m = re.match(rf"((?:\\.|[^\\{separators}])*)[{separators}](.*)", own, re.S)
    if not m or not (key := m[1].rstrip()):
        return []
    raw = m[2].strip()
    if raw[:1] not in ("'", '"'):
        raw = re.sub(r"(?<=[ \t])[#;].*$", "", raw, flags=re.S).rstrip()
    value = raw[1:-1] if len(raw) > 1 and raw[0] == raw[-1] and raw[0] in "\"'" else raw
    if not value:
        return []
    if not joined:  # the place of the value itself
        start = start + line.rindex(m[2]) + len(m[2]) - len(m[2].lstrip()) if m[2] else start
        end = start + len(raw)
    return [Item("assignment", key, kind, value, start, end)]


def netrc(text: str) -> list[Item]:
    return [Item("password", "password", "Property", m[1], m.start(1), m.end(1)) for m in re.finditer(r"(?:^|\s)password\s+(\S+)", text)]


def pgpass(text: str) -> list[Item]:
    found = []
    for at, line in _lines(text):
        fields = re.findall(r"(?:\\.|[^:\\])*", line)[::1] if line and not line.startswith("#") else []
        fields = re.split(r"(?<!\\):", line) if fields else []
        if len(fields) >= 5 and fields[4]:
            found.append(Item("password", "password", "Property", re.sub(r"\\(.)", r"\1", fields[4]), at + len(line) - len(":".join(fields[4:])), at + len(line)))
    return found


def esmtprc(text: str) -> list[Item]:
    pattern = re.compile(r"""^[ \t]*(password|passwd|pwd)[ \t]*[= \t][ \t]*["']?([^"'\r\n]+)""", re.I | re.M)
    return [Item("password", m[1].lower(), "Property", m[2].strip(), m.start(2), m.end(2)) for m in pattern.finditer(text)]


def git_credentials(text: str) -> list[Item]:
    return [Item("value", None, None, line.strip(), at, at + len(line)) for at, line in _lines(text) if line.strip()]


def redis(text: str) -> list[Item]:
    """Password directives, and the passwords and hashes of `user` rules: credentials by their place."""
    found = [Item("credential", m[1].lower(), "Directive", m[2], m.start(2), m.end(2)) for m in re.finditer(r"""^[ \t]*(masterauth|requirepass|tls-key-file-pass|tls-client-key-file-pass)[ \t]+["']?([^"' \t\r\n]+)""", text, re.I | re.M)]
    for user in re.finditer(r"^[ \t]*user[ \t]+(\S+)([^\n]*)", text, re.I | re.M):
        found += [Item("credential", user[1], "User", rule[1], user.start(2) + rule.start(1), user.start(2) + rule.end(1)) for rule in re.finditer(r"(?<=[ \t])[><#!](\S+)", user[2])]
    return found


_JSON = re.compile(r'(?P<string>"(?:[^"\\]|\\.)*")|(?P<comment>//[^\n]*|/\*[\s\S]*?\*/)|(?P<mark>[{}\[\]:,])|(?P<bare>[^\s{}\[\]:,"/]+)|(?P<odd>\S)')


def json(text: str, hook: Hook | None = None) -> list[Item] | None:
    """Object keys with their dotted scope, strings of arrays as bare values; comments, trailing commas and bare names are allowed.

    ``hook`` (scope, key) tells which strings are shell commands; those of an array belong to the array's key.
    """
    found: list[Item] = []
    stack: list[tuple[str, str | None]] = []  # (bracket, key that holds it)
    key, pending, seen = None, None, False
    for m in _JSON.finditer(text):
        if m["comment"]:
            continue
        seen = True
        if m["odd"] or m["bare"] and not stack and not re.fullmatch(r"true|false|null|-?[0-9.eE+-]+", m["bare"]):
            return None
        if m["string"]:
            try:
                value = code._unescaped(m["string"][1:-1])
            except ValueError:
                return None
            if stack and stack[-1][0] == "{" and key is None:
                pending = value
                continue
            scope = tuple(k for b, k in stack if k is not None and b)
            found += _scalar(value, key if stack and stack[-1][0] == "{" else None, stack, m.start() + 1, m.end() - 1, hook, scope)
            key = None if stack and stack[-1][0] == "{" else key
        elif m["mark"] == ":":
            if pending is None or not stack or stack[-1][0] != "{":
                return None
            key, pending = pending, None
        elif m["mark"] in ("{", "["):
            stack.append((m["mark"], key))
            key = None
        elif m["mark"] in ("}", "]"):
            if not stack or {"{": "}", "[": "]"}[stack[-1][0]] != m["mark"] or pending is not None:
                return None
            stack.pop()
            key = None
        elif m["bare"] and stack and stack[-1][0] == "{" and key is None:
            pending = m["bare"]
        else:
            if pending is not None:
                return None
            key = None
    return found if seen and not stack else None


def _scalar(value: str, key: str | None, stack, start: int, end: int, hook: Hook | None, scope: tuple[str, ...]) -> list[Item]:
    owner, path = key, scope
    if key is None and scope:
        owner, path = scope[-1], scope[:-1]
    if hook and owner is not None and hook(path, owner):
        return shifted(shell.extract(value), start)
    if key is None:
        return [Item("value", None, None, value, start, end)]
    return [Item("assignment", key, "Element", value, start, end, scope)]


def toml(text: str) -> list[Item] | None:
    """Keys under their table's scope; an array of tables shares its name."""
    import tomllib

    try:
        tomllib.loads(text)
    except (tomllib.TOMLDecodeError, RecursionError):
        return None
    found, table = [], ()
    pattern = re.compile(r"""(?P<table>^[ \t]*\[\[?([^\[\]\n]+)\]\]?)|(?P<comment>\#[^\n]*)|(?P<string>\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|"(?:[^"\\\n]|\\.)*"|'[^'\n]*')|(?P<word>[A-Za-z0-9_-]+)|(?P<mark>[=.,{}\[\]])|(?P<line>\n)""", re.M)
    path, key, depth, scope = [], None, [], ()
    for m in pattern.finditer(text):
        if m["table"] and not depth:
            table, path, key = tuple(p.strip().strip("\"'") for p in m[2].split(".")), [], None
        elif m["comment"]:
            continue
        elif m["string"] or m["word"]:
            value = m["word"] or code.unquoted(m["string"]).removeprefix("\n")
            if key is None and not (depth and depth[-1] == "["):
                path.append(value)
            elif m["string"]:
                held = depth and depth[-1] == "["
                found.append(Item("value", None, None, value, m.start(), m.end()) if held else Item("assignment", key, "Element", value, m.start(), m.end(), table + scope))
        elif m["mark"] == "=":
            key, scope = path[-1] if path else None, (*scope, *path[:-1])
            path = []
        elif m["mark"] in ("{", "["):
            depth.append(m["mark"])
            if m["mark"] == "{" and key is not None:
                scope, key = (*scope, key), None
        elif m["mark"] in ("}", "]") and depth:
            depth.pop()
        elif m["mark"] == "," and depth and depth[-1] == "{":
            key = None
        elif m["line"] and not depth:
            path, key, scope = [], None, ()
    return found


def yaml(text: str, hook: Hook | None = None) -> list[Item]:
    """Keys with their scope; `name` or `key` beside `value` in one mapping is an assignment; block scalars are read again as YAML or configuration lines."""
    try:
        import yaml as parser
    except ImportError:  # the library is optional: without it a YAML file is read as lines
        return config(text)
    found: list[Item] = []
    stack: list[dict] = []  # of mappings and sequences: key, scope, pairs

    def scalar(value: str, start: int, end: int, block: bool) -> None:
        top = stack[-1] if stack else {"kind": "seq", "scope": (), "key": None}
        if top["kind"] == "map" and top["key"] is None:
            top["key"] = value
            return
        owner = top["key"]
        path = top["scope"]
        if top["kind"] == "seq" and path:
            owner, path = path[-1], path[:-1]
        if hook and owner is not None and hook(path, owner):
            found.extend(shifted(shell.extract(value), start))
        elif block and "\n" in value.strip():
            inner = yaml(value) if ": " in value else config(value)
            found.extend(Item(i.kind, i.name, i.assignment_type, i.value, start, end, i.scope) for i in inner)
        elif top["kind"] == "map":
            found.append(Item("assignment", owner, "Element", value, start, end, path))
            top["pairs"][owner] = (value, start, end)
        else:
            found.append(Item("value", None, None, value, start, end))
        if top["kind"] == "map":
            top["key"] = None

    try:
        for event in parser.parse(text, Loader=parser.SafeLoader):
            if isinstance(event, parser.ScalarEvent):
                scalar(event.value, event.start_mark.index, event.end_mark.index, event.style in ("|", ">"))
            elif isinstance(event, (parser.MappingStartEvent, parser.SequenceStartEvent)):
                top = stack[-1] if stack else None
                scope = () if top is None else (*top["scope"], top["key"]) if top["kind"] == "map" and top["key"] is not None else top["scope"]
                stack.append({"kind": "map" if isinstance(event, parser.MappingStartEvent) else "seq", "scope": scope, "key": None, "pairs": {}})
            elif isinstance(event, (parser.MappingEndEvent, parser.SequenceEndEvent)):
                ended = stack.pop()
                name, value = ended["pairs"].get("name") or ended["pairs"].get("key"), ended["pairs"].get("value")
                if name and value:
                    found.append(Item("assignment", name[0], "Element", *value, ended["scope"]))
                if stack and stack[-1]["kind"] == "map":
                    stack[-1]["key"] = None
            elif isinstance(event, parser.AliasEvent):
                scalar("", event.start_mark.index, event.end_mark.index, False)
            elif isinstance(event, parser.DocumentEndEvent):
                break  # the first document
    except parser.YAMLError:
        pass
    return [i for i in found if i.value]


def secret_manifest(text: str) -> list[Item]:
    """A cluster's Secret manifest: `stringData` as it is and `data` decoded from base64, as credentials by their place; the rest as YAML."""
    found = []
    for i in yaml(text):
        if i.kind == "assignment" and i.scope[:1] in (("data",), ("stringData",)):
            value = i.value
            if i.scope[0] == "data":
                try:
                    value = base64.b64decode(value, validate=True).decode()
                except ValueError:
                    continue
            i = Item("credential", i.name, "Element", value, i.start, i.end)
        found.append(i)
    return found


class _Offsets:
    """Code-point offsets of expat's byte places."""

    def __init__(self, text: str):
        self.raw, self.ascii = text.encode(), text.isascii()

    def __call__(self, at: int) -> int:
        return at if self.ascii else len(self.raw[:at].decode(errors="ignore"))


def xml(text: str) -> list[Item] | None:
    """Attributes; `name` or `key` beside `value`; text under its tag's name, or its name or key attribute."""
    found: list[Item] = []
    stack: list[list] = []  # (name, text, start)
    offsets, parser = _Offsets(text), expat.ParserCreate()

    def begin(tag, attributes):
        at = offsets(parser.CurrentByteIndex)
        named = attributes.get("name") or attributes.get("key")
        for key, value in attributes.items():
            place = text.find(value, at) if value else at
            place = at if place < 0 else place
            if key == "value" and named:
                found.append(Item("assignment", named, "Property", value, place, place + len(value)))
            else:
                found.append(Item("assignment", key, "Property", value, place, place + len(value)))
        stack.append([named or tag.rpartition(":")[2], "", None])

    def chars(data):
        if stack:
            stack[-1][2] = offsets(parser.CurrentByteIndex) if stack[-1][2] is None else stack[-1][2]
            stack[-1][1] += data

    def end(_):
        name, held, start = stack.pop()
        if held.strip():
            found.append(Item("assignment", name, "Element", held.strip(), start, start + len(held)))

    parser.StartElementHandler, parser.CharacterDataHandler, parser.EndElementHandler = begin, chars, end
    try:
        parser.Parse(text.encode(), True)
    except (expat.ExpatError, ValueError):
        return None
    return [i for i in found if i.value]


def plist(text: str | None, raw: bytes | None = None) -> list[Item] | None:
    """Key and string pairs of a property list, XML or binary; binary ones have no places."""
    try:
        tree = plistlib.loads(raw if raw is not None else text.encode())
    except Exception:  # noqa: BLE001 - plistlib raises many kinds
        return None
    found, stack, at = [], [(None, tree)], 0
    while stack:
        key, node = stack.pop()
        if isinstance(node, dict):
            stack += [(k, v) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            stack += [(key, v) for v in reversed(node)]
        elif isinstance(node, str) and node:
            place = text.find(node, at) if text else -1
            at = place + len(node) if place >= 0 else at
            found.append(Item("assignment", key, "Element", node, max(place, 0), max(place, 0) + len(node)) if key else Item("value", None, None, node, max(place, 0), max(place, 0) + len(node)))
    return found


_HCL = re.compile(r'(?P<here><<-?(\w+)\n([\s\S]*?)\n[ \t]*\2\b)|(?P<string>"(?:[^"\\\n]|\\.)*")|(?P<comment>#[^\n]*|//[^\n]*|/\*[\s\S]*?\*/)|(?P<word>[A-Za-z_][\w-]*)|(?P<mark>==|!=|<=|>=|&&|\|\||[={}\[\]():?,])|(?P<line>\n)')


def hcl(text: str) -> list[Item] | None:
    """Attributes as properties (of a backend's configuration inside `terraform { backend }`); `variable "x" { default }` is a variable; command attributes are shell.

    A value is reached through conditionals, calls, brackets and parentheses.
    """
    found: list[Item] = []
    blocks: list[tuple[str, str]] = []  # (type, last label), or an object's key
    head: list[str] = []
    key, depth = None, 0
    for m in _HCL.finditer(text):
        if m["comment"]:
            continue
        if m["here"] or m["string"]:
            value = m[3] if m["here"] else code.unquoted(m["string"])
            start = m.start(3) if m["here"] else m.start() + 1
            if key is None:
                head.append(value)
                continue
            inside = [b for b, _ in blocks]
            if key in ("command", "inline", "user_data") or "provisioner" in inside and key == "environment":
                found += shifted(shell.extract(value), start)
            elif key == "default" and inside[-1:] == ["variable"]:
                found.append(Item("assignment", blocks[-1][1], "Variable", value, start, start + len(value)))
            else:
                found.append(Item("assignment", key, "BackendConfig" if inside[:1] == ["terraform"] and "backend" in inside else "Property", value, start, start + len(value)))
        elif m["word"]:
            if key is None:
                head.append(m["word"])
        elif m["mark"] in ("=", ":") and head and key is None:
            key, head = head[-1], []
        elif m["mark"] == "{":
            blocks.append((head[0], head[-1]) if key is None and head else (key or "", key or ""))
            key, head = None, []
        elif m["mark"] == "}":
            if not blocks:
                return None
            blocks.pop()
            key, head = None, []
        elif m["mark"] in ("[", "("):
            depth += 1
        elif m["mark"] in ("]", ")"):
            depth -= 1
        elif m["mark"] == "," and depth <= 0 or m["line"] and depth <= 0:
            key, head = None, []
    return None if blocks else found


_VARIABLE = re.compile(r"\$(?:\{(\w+)(?:(:?[-+])([^}]*))?\}|(\w+))")


def substituted(value: str, known: dict[str, str], depth: int = 0) -> str:
    """Variable references replaced by a stage's definitions; `:-` and `-` give defaults, `:+` and `+` alternatives."""
    if depth > 16 or "$" not in value:
        return value

    def one(m):
        name, sign, other = m[1] or m[4], m[2] or "", m[3] or ""
        held = known.get(name)
        there = bool(held) if sign.startswith(":") else held is not None
        if sign.endswith("+"):
            return substituted(other, known, depth + 1) if there else ""
        if there:
            return substituted(held, {k: v for k, v in known.items() if k != name}, depth + 1)
        return substituted(other, known, depth + 1) if sign.endswith("-") else m[0]

    return _VARIABLE.sub(one, value)


def dockerfile(text: str) -> list[Item] | None:
    """ENV, ARG and LABEL with their stage's variables put in; RUN in its shell form is shell."""
    found: list[Item] = []
    known: dict[str, str] = {}
    shared: dict[str, str] = {}
    stages, kinds = 0, {"env": "EnvironmentVariable", "arg": "BuildArgument", "label": "Property"}
    for m in re.finditer(r"^[ \t]*([A-Za-z]+)[ \t]+((?:[^\n\\]|\\\r?\n(?:[ \t]*#[^\n]*\n)*|\\.)*)", text, re.M):
        word, rest, at = m[1].lower(), m[2], m.start(2)
        if word == "from":
            stages += 1
            known = dict(shared)
        elif word in kinds:
            pairs = [(p[1], p[2] if p[2] is not None else "", p.start(), p.end()) for p in re.finditer(r"""([\w.-]+)(?:=((?:"(?:[^"\\]|\\.)*"|'[^']*'|\\[\s\S]|[^\s"'])*))?""", rest)] if "=" in rest or word == "arg" else [(s[0], s[1], 0, len(rest)) for s in [rest.split(None, 1)] if len(s) == 2]
            for name, raw, start, end in pairs:
                value = substituted(re.sub(r"""^(["'])([\s\S]*)\1$""", r"\2", raw).replace("\\ ", " "), known)
                if word != "label":
                    (known if stages else shared)[name] = value
                    known[name] = value
                if value:
                    found.append(Item("assignment", name, kinds[word], value, at + start, at + end))
        elif word == "run" and not rest.lstrip().startswith("["):
            found += shifted(shell.extract(rest), at)
    return found if stages or found else None


_SQL = re.compile(
    r"(?P<comment>--[^\n]*|/\*[\s\S]*?\*/)|(?P<dollar>\$(\w*)\$([\s\S]*?)\$\3\$)|(?P<q>[qQ]'(?:\[([\s\S]*?)\]|\{([\s\S]*?)\}|\(([\s\S]*?)\)|<([\s\S]*?)>|(\W)([\s\S]*?)\10)')"
    r"|(?P<string>[EeNnBbXx]?'(?:[^']|'')*')|(?P<word>[@:#]*[A-Za-z_][\w$]*|\"[^\"\n]*\"|`[^`\n]*`)|(?P<op>:=|=|[^\s\w])"
)
# Words that announce a credential, with its name, and column types between a name and its default.
SQL_KEYWORDS = {"password": "password", "passwd": "passwd", "pwd": "pwd", "secret": "secret", "identified": "password"}
SQL_TYPES = frozenset(
    "int integer bigint smallint tinyint bit decimal numeric dec float real double money smallmoney char character varchar varchar2 nchar nvarchar text ntext string binary varbinary bytea blob clob "
    "date datetime datetime2 smalldatetime time timestamp year bool boolean uuid uniqueidentifier xml json jsonb".split()
)


def sql(text: str, depth: int = 0) -> list[Item]:
    """String literals: named by a credential word among the 6 tokens before, or by the target of `=` or `:=`, typed or not; else bare values.

    The 16 tokens before a literal are kept. Dollar-quoted bodies are read again, four deep.
    """
    found: list[Item] = []
    recent: list[str] = []
    for m in _SQL.finditer(text):
        if m["comment"]:
            continue
        if m["dollar"] and depth < 4 and re.search(r"\s", m[4]):
            found += shifted(sql(m[4], depth + 1), m.start(4))
        elif m["dollar"] or m["q"] or m["string"]:
            value = m[4] if m["dollar"] else next((g for g in (m[6], m[7], m[8], m[9], m[11]) if g is not None), "") if m["q"] else m["string"].lstrip("EeNnBbXx")[1:-1].replace("''", "'")
            found.append(_sql_literal(value, recent, m.start(), m.end()))
            recent.append("'")
        else:
            recent.append(m["word"] or m["op"])
        del recent[:-16]
    return [i for i in found if i.value]


def _sql_literal(value: str, recent: list[str], start: int, end: int) -> Item:
    lower = [w.lower() for w in recent]
    if lower and lower[-1] in ("=", ":="):
        k = len(lower) - 2
        if k >= 0 and lower[k] == ")":  # a type's length
            while k > 0 and lower[k] != "(":
                k -= 1
            k -= 1
        if k > 0 and lower[k] in SQL_TYPES:
            k -= 1
        if k >= 0 and re.fullmatch(r"[@:#\"`]*\w[\w$ ]*[\"`]?", recent[k]):
            name = recent[k].strip("@:#\"`")
            return Item("assignment", name, "Variable" if recent[k][:1] in "@:" or lower[-1] == ":=" else "Property", value, start, end)
    for word in reversed(lower[-6:]):
        if word == ";":
            break
        if word in SQL_KEYWORDS:
            return Item("assignment", SQL_KEYWORDS[word], "Property", value, start, end)
    return Item("value", None, None, value, start, end)


def notebook(text: str) -> list[tuple[str, str, int]] | None:
    """(language, source, offset of the cell in the file) of a notebook's code cells."""
    import json as parser

    try:
        book = parser.loads(text)
        cells = book["cells"]
    except (ValueError, KeyError, TypeError, RecursionError):
        return None
    kernel = ((book.get("metadata") or {}).get("kernelspec") or {}).get("language") or "python"
    found, at = [], 0
    for cell in cells if isinstance(cells, list) else ():
        if isinstance(cell, dict) and cell.get("cell_type") == "code":
            source = cell.get("source", "")
            source = "".join(map(str, source)) if isinstance(source, list) else str(source)
            at = max(text.find('"source"', at + 1), at)
            found.append((str(kernel).lower(), source, at))
    return found


# Schema handlers: which strings of a configuration file are shell commands, by the file's place.


def _under(first: str, keys: tuple[str, ...], depth: int | None = None, least: int = 0) -> Hook:
    return lambda path, key: key in keys and path[:1] == (first,) and (len(path) == depth if depth else len(path) >= least)


_SCHEMAS = (
    (r"(?:^|/)package\.json$", "PackageJson", lambda path, key: path == ("scripts",)),
    (r"(?:^|/)tasks\.json$", "VscodeTasks", lambda path, key: path == ("tasks",) and key == "command"),
    (r"(?:^|/)(?:docker-compose|compose)\.json$", "DockerCompose", _under("services", ("command", "entrypoint"), depth=2)),
    (r"(?:^|/)(?:claude_desktop_config|\.?mcp)\.json$", "McpConfig", _under("mcpServers", ("command",), depth=2)),
    (r"(?:^|/)azure-pipelines\.ya?ml$", "AzurePipelines", lambda path, key: key in ("script", "bash", "powershell")),
    (r"(?:^|/)buildspec\.ya?ml$", "AwsCodeBuild", _under("phases", ("commands", "finally"), least=2)),
    (r"(?:^|/)bitbucket-pipelines\.yml$", "BitbucketPipelines", lambda path, key: key == "script"),
    (r"(?:^|/)(?:docker-compose|compose)\.ya?ml$", "DockerCompose", _under("services", ("command", "entrypoint"), depth=2)),
    (r"(?:^|/)\.drone\.ya?ml$", "Drone", lambda path, key: key == "commands"),
    (r"(?:^|/)\.gitlab-ci\.yml$", "GitlabCi", lambda path, key: key in ("script", "before_script", "after_script")),
    (r"(?:^|/)\.travis\.yml$", "TravisCi", lambda path, key: not path and key in ("script", "before_script", "after_script", "before_install", "install")),
    (r"\.github/workflows/[^\n]*\.ya?ml$", "GithubActions", _under("jobs", ("run",), least=2)),
    (r"\.circleci/config\.ya?ml$", "CircleCi", _under("jobs", ("run", "command"), least=2)),
    (r"\.buildkite/[^\n]*\.ya?ml$", "Buildkite", lambda path, key: key in ("command", "commands")),
)


def schema(path: str) -> tuple[str, Hook] | None:
    """(file type, hook) of the first schema that a path names."""
    return next(((kind, hook) for pattern, kind, hook in _SCHEMAS if re.search(pattern, path)), None)
