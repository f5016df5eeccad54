"""The scan of one file: routing, extraction, classification, suppression.

``mode="sane"`` scans every text; ``"compat"`` also skips what routing by the first byte skips:
texts that begin with a control character, and texts whose first byte a binary detector takes.
A file whose extraction fails is reported with its error, and the scan goes on.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from brindle.functions.fingerprint import fingerprint
from brindle.scanner import code, data, detect, markup, shell
from brindle.scanner.items import Item
from brindle.scanner.verdicts import Finding, Judge, matched_signature, value_severity
from brindle.sources import services, signatures
from brindle.sources.files import BY_EXTENSION, BY_NAME

# What counts as a declarative configuration file, and interpreters of scripts.
DECLARATIVE = ("DotEnv", "FlaskEnv", "GitConfig", "Npmrc", "Pypirc", "EditorConfig", "Ini", "Properties", "Json", "Yaml", "Toml", "Xml", "Hcl", "Plist")
CONFIG_TYPES = ("DotEnv", "FlaskEnv", "GitConfig", "Npmrc", "Pypirc", "EditorConfig", "Ini", "Properties")
USER_DATABASES = ("shadow", "gshadow", "passwd", "master.passwd", ".htpasswd", ".htdigest")
INTERPRETERS = ((r"(?:ba|z|k|a|da)?sh", "Shell"), (r"python.*", "Python"), (r"ruby.*", "Ruby"), (r"node.*|deno|bun", "JavaScript"), (r"php", "Php"))
_READERS = {
    "Netrc": data.netrc, "Pgpass": data.pgpass, "Esmtprc": data.esmtprc, "GitCredentials": data.git_credentials, "Redis": data.redis, "Shell": shell.extract, "Json": data.json, "Yaml": data.yaml, "Toml": data.toml, "Xml": data.xml,
    "Plist": data.plist, "Dockerfile": data.dockerfile, "Hcl": data.hcl, "Sql": data.sql, "Html": markup.html, "Vue": markup.vue, "Svelte": markup.svelte, "Astro": markup.astro, "Php": markup.php, "Blade": markup.blade,
    "Ejs": markup.ejs, "Erb": markup.erb, "Razor": markup.razor, "Twig": markup.twig, "Liquid": markup.liquid,
}


def file_type(path: str) -> str | None:
    """By name, prefix or extension; a file without an extension reads as Ini, an unknown one as None."""
    name = path.rsplit("/", 1)[-1].lower()
    if name == ".env" or name.startswith(".env."):
        return "DotEnv"
    if name in BY_NAME:
        return BY_NAME[name]
    for stem, found in (("dockerfile", "Dockerfile"), ("jenkinsfile", "Groovy")):
        if name == stem or name.startswith(f"{stem}.") or name.endswith(f".{stem}"):
            return found
    if re.fullmatch(r"(?:redis|sentinel)(?:-.*)?\.conf", name):
        return "Redis"
    if name.endswith(".blade.php"):
        return "Blade"
    extension = m[1] if (m := re.match(r".+\.([^.]*)$", name)) else ""
    return next((kind for kind, own in BY_EXTENSION.items() if extension in own.split()), None if extension else "Ini")


def resolved_type(path: str, text: str) -> str | None:
    """The file type, with the shebang deciding for a file without an extension."""
    own = file_type(path)
    name = path.rsplit("/", 1)[-1]
    if own == "Ini" and "." not in name.lstrip("."):
        m = re.match(r"#!\s*(\S+)(?:[ \t]+(\S+))?", text)
        if m:
            words = [w.rsplit("/", 1)[-1] for w in (m[1], m[2] or "")]
            called = words[1] if words[0] == "env" else words[0]
            return next((kind for pattern, kind in INTERPRETERS if re.fullmatch(pattern, called)), own)
        if re.match(r"\s*(?:-----BEGIN |PuTTY-User-Key-File-)", text):
            return None  # a key and no configuration
    return own


def items(path: str, text: str) -> tuple[str | None, list[Item] | None]:
    """(file type, candidates), with None where no extractor takes the file or it doesn't parse."""
    if found := data.schema(path):
        kind, hook = found
        return kind, data.json(text, hook) if path.endswith(".json") else data.yaml(text, hook)
    if path.endswith((".yml", ".yaml")) and re.search(r"^kind:[ \t]*[\"']?Secret\b", text, re.M) and re.search(r"^apiVersion:", text, re.M):
        return "K8sSecret", data.secret_manifest(text)
    kind = resolved_type(path, text)
    if kind == "Jupyter":
        cells = data.notebook(text)
        if cells is None:
            return kind, None
        names = {k.lower(): k for k in code.LANGUAGES} | {"bash": "Shell", "r": None}
        out: list[Item] = []
        for language, source, at in cells:
            own = names.get(language)
            for i in shell.extract(source) if own == "Shell" else code.extract(own, source) if own else ():
                out.append(Item(i.kind, i.name, i.assignment_type, i.value, at, at, i.scope))
        return kind, out
    if kind in CONFIG_TYPES:
        return kind, data.config(text, "UserDatabase" if path.rsplit("/", 1)[-1].lower() in USER_DATABASES else kind)
    if kind in _READERS:
        return kind, _READERS[kind](text)
    return kind, code.extract(kind, text) if kind in code.LANGUAGES else None


def _judged(judge: Judge, item: Item) -> Finding | None:
    place = item.start, item.end
    if item.kind == "assignment":
        return judge.assignment(item.name, item.value, item.assignment_type, *place, item.scope) or judge.value(item.value, *place)
    if item.kind == "header":
        return judge.header(item.name, item.value, *place)
    if item.kind == "credential":
        return judge.credential(item.name, item.value, item.assignment_type, *place)
    if item.kind == "password":
        return judge.password_field(item.name, item.value, item.assignment_type, *place)
    return judge.value(item.value, *place)


def _content(text: str) -> list[Finding]:
    found = []
    for start, end, ordinal in signatures.matcher().hits(text):
        value = None if detect.in_base64(text, start, end) else matched_signature(ordinal, text[start:end])
        severity = value and value_severity(value.kind)
        if severity:
            found.append(Finding("secret-value", severity, None, None, value.kind, value.detail, start, end, fingerprint("secret-value", text[start:end]), True))
    return found


def _blocks(path: str, text: str) -> list[Finding]:
    if key := detect.rails_key(path, text):
        return [Finding("text-secret", "critical", None, None, "RailsKey", "Rails master key", None, None, fingerprint("text-secret", key))]
    blocks = detect.key_blocks(text)
    if blocks and detect.only_filler(text, blocks):
        kind, shown, start, end = blocks[0]
        return [Finding("text-secret", "critical", None, None, kind, shown, None, None, fingerprint("text-secret", text[start:end]))]
    return [Finding("secret-value", "critical", None, None, kind, shown, start, end, fingerprint("secret-value", text[start:end])) for kind, shown, start, end in blocks]


def skipped_lines(text: str, marker: str = "brindle:skip", most: int = 20) -> list[tuple[int, int]]:
    """Line ranges that skip directives cover: a trailing one its own line, a leading one the next line that isn't blank and the deeper block below."""
    if marker not in text:
        return []
    lines, found = text.split("\n"), []
    depth = lambda i: len(lines[i]) - len(lines[i].lstrip())
    for i, line in enumerate(lines):
        at = line.find(marker)
        if at < 0:
            continue
        if line[:at].strip(" \t#/*;-<!%'"):
            found.append((i + 1, i + 1))
            continue
        first = next((j for j in range(i + 1, len(lines)) if lines[j].strip()), None)
        if first is not None:
            last = first
            while last + 1 < len(lines) and last + 1 - first < most and lines[last + 1].strip() and depth(last + 1) > depth(first):
                last += 1
            found.append((first + 1, last + 1))
    return found


class _Furthest:
    """The furthest end among intervals that start by a place, under additions (a Fenwick tree)."""

    def __init__(self, starts):
        self.starts = sorted(set(starts))
        self.ends = [-1] * (len(self.starts) + 1)

    def add(self, start: int, end: int) -> None:
        i = bisect_left(self.starts, start) + 1
        while i < len(self.ends):
            self.ends[i] = max(self.ends[i], end)
            i += i & -i

    def by(self, place: int) -> int:
        i, found = bisect_right(self.starts, place), -1
        while i:
            found = max(found, self.ends[i])
            i -= i & -i
        return found


def _without_repeats(found: list[Finding]) -> list[Finding]:
    """The findings that no earlier one of the extractor encloses; those without a place all stay."""
    tree, kept = _Furthest(f.start for f in found if f.start is not None), []
    for f in found:
        if f.start is None or f.end == f.start or tree.by(f.start) < f.end:
            kept.append(f)
        if f.start is not None and f.end > f.start:
            tree.add(f.start, f.end)
    return kept


def superseded(found: list[Finding]) -> list[Finding]:
    """Without content-scan findings that overlap an extractor's, and findings enclosed by one of higher severity; losers still beat others."""
    placed = [f for f in found if f.start is not None]
    own, high, same = _Furthest(f.start for f in placed), _Furthest(f.start for f in placed), {}
    for f in placed:
        if not f.from_content_scan:
            own.add(f.start, f.end)
        if f.severity == "critical":
            high.add(f.start, f.end)
            same[f.start] = max(same.get(f.start, -1), f.end)

    def beaten(f: Finding) -> bool:
        if f.start is None:
            return False
        enclosed = f.severity != "critical" and (high.by(f.start - 1) >= f.end or same.get(f.start, -1) > f.end)
        return enclosed or f.from_content_scan and own.by(f.end - 1) > f.start

    return [f for f in found if not beaten(f)]


def scan_text(path: str, text: str, judge: Judge | None = None, mode: str = "sane") -> tuple[str | None, list[Finding]]:
    """(file type, findings) of a text: signatures anywhere, the file type's candidates, and key blocks where no extractor takes the file."""
    if not text or mode == "compat" and re.match(r"[\x00-\x1a\x1c-\x1f\x7f]", text):
        return None, []
    kind, own = items(path, text)
    if judge is None:
        judge = Judge(path)
    judge.declarative = kind in DECLARATIVE or file_type(path) in DECLARATIVE
    # Schema files and shell parts of others are judged without the path's services.
    judge.services = () if data.schema(path) else tuple(s for s in services.SERVICES if s[0] in path.lower())
    found = _without_repeats([f for f in (_judged(judge, i) for i in own or ()) if f])
    covered = skipped_lines(text)
    line = lambda f: text.count("\n", 0, f.start) + 1
    found = [f for f in found if not any(a <= line(f) <= b for a, b in covered)]
    found += _content(text) + (_blocks(path, text) if own is None else [])
    return kind, superseded(found)


def scan_bytes(path: str, raw: bytes, judge: Judge | None = None, mode: str = "sane") -> tuple[str | None, list[Finding]]:
    """The same of a file's bytes: a binary detector for its first byte, else its text if it is UTF-8."""
    if shown := detect.binary(raw):
        return None, [Finding("binary-secret", "critical", None, None, "Binary", shown, None, None, fingerprint("binary-secret", raw.decode("latin-1")))]
    if mode == "compat" and raw[:1] in (b"\x30", b"\xc5", b"\xc7", b"\xce"):
        return None, []
    if raw[:6] == b"bplist":
        judge = judge or Judge(path, declarative=True)
        return "Plist", _without_repeats([f for f in (_judged(judge, i) for i in data.plist(None, raw) or ()) if f])
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None, []
    return scan_text(path, text, judge, mode)
