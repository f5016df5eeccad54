"""Extraction from markup and templates: attributes and regions that other extractors read, with the file's offsets.

A region is read in a text whose other parts are blank, so its places are the file's.
"""

from __future__ import annotations

import html as entities
import re

from brindle.scanner import code
from brindle.scanner.items import Item, mask, unmask

_TAG = re.compile(r"<!--[\s\S]*?-->|<([A-Za-z][\w:.-]*)((?:\s+|/)(?:[^>\"'`{}]|\"[^\"]*\"|'[^']*'|`[^`]*`|\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\})*)?>")
_ATTRIBUTE = re.compile(r"""([@:#A-Za-z_][\w:@.#-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>=`{]+))""")
_SCRIPT = re.compile(r"<(script|style)\b([^>]*)>([\s\S]*?)</\1\s*>", re.I)


def _attributes(tag: re.Match) -> list[tuple[str, str, int, int]]:
    found = []
    for m in _ATTRIBUTE.finditer(tag[2] or ""):
        group = next(g for g in (2, 3, 4) if m[g] is not None)
        at = tag.start(2)
        found.append((m[1], entities.unescape(m[group]), at + m.start(group), at + m.end(group)))
    return found


def html(text: str, skip: list[tuple[int, int]] | None = None, bound: str | None = None) -> list[Item]:
    """Every attribute; a meta tag's content under its name, property or http-equiv; scripts as JavaScript that share their functions.

    ``bound``: a pattern of attribute names whose values are code and are left to the caller.
    """
    shown = unmask(text, skip or [])
    found, scripts = [], []
    for m in _SCRIPT.finditer(shown):
        if m[1].lower() == "script" and re.search(r"""type\s*=\s*["']?(?:text/template|text/html|application/ld|text/x-)""", m[2], re.I) is None:
            scripts.append((m.start(3), m.end(3)))
    bodies = [(m.start(3), m.end(3)) for m in _SCRIPT.finditer(shown)]
    for tag in _TAG.finditer(unmask(shown, bodies)):
        if tag[1] is None:
            continue
        own = _attributes(tag)
        named = {k.lower(): v for k, v, _, _ in own}
        subject = named.get("name") or named.get("property") or named.get("http-equiv") if tag[1].lower() == "meta" else None
        for key, value, start, end in own:
            if not value or bound and re.match(bound, key):
                continue
            if subject and key.lower() == "content":
                found.append(Item("header" if named.get("http-equiv") else "assignment", subject, "Attribute", value, start, end))
            else:
                found.append(Item("assignment", key, "Attribute", value, start, end))
    known: dict[str, list[str]] = {}
    for start, end in scripts:
        known |= code.definitions("JavaScript", mask(shown, [(start, end)]))
    for start, end in scripts:
        found += code.extract("JavaScript", mask(shown, [(start, end)]), known)
    return found


def _regions(text: str, pattern: str, group: int = 1, flags: int = 0) -> list[tuple[int, int]]:
    return [(m.start(group), m.end(group)) for m in re.finditer(pattern, text, flags)]


def _read(language: str, text: str, regions: list[tuple[int, int]]) -> list[Item]:
    return [i for region in regions for i in code.extract(language, mask(text, [region]))] if regions else []


def vue(text: str) -> list[Item]:
    """Scripts, interpolations and bound attributes as JavaScript, other attributes as they are."""
    bound = r"[:@#]|v-"
    values = [(m.start(2), m.end(2)) for m in re.finditer(r"""\s(?:[:@#]|v-)[\w:.@#-]*\s*=\s*("([^"]*)")""", text)]
    return html(text, bound=bound) + _read("JavaScript", unmask(text, [(m.start(3), m.end(3)) for m in _SCRIPT.finditer(text)]), _regions(text, r"\{\{([\s\S]*?)\}\}") + values)


def svelte(text: str) -> list[Item]:
    """Scripts, and expressions in braces in text and attributes, as JavaScript."""
    bodies = [(m.start(3), m.end(3)) for m in _SCRIPT.finditer(text)]
    shown = unmask(text, bodies)
    return html(text) + _read("JavaScript", shown, _regions(shown, r"\{(?:[#:/@]\w+)?([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"))


def astro(text: str) -> list[Item]:
    """The front matter and expressions in braces as JavaScript."""
    front = re.match(r"\s*---\n([\s\S]*?)\n---", text)
    regions = [(front.start(1), front.end(1))] if front else []
    body = unmask(text, [(0, front.end())] if front else [])
    shown = unmask(body, [(m.start(3), m.end(3)) for m in _SCRIPT.finditer(body)])
    known = code.definitions("JavaScript", mask(text, regions)) if regions else {}
    read = [i for r in regions for i in code.extract("JavaScript", mask(text, [r]))]
    return read + html(body) + [i for r in _regions(shown, r"\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}") + _regions(shown, r"=(`[^`]*`)") for i in code.extract("JavaScript", mask(shown, [r]), known)]


def php(text: str) -> list[Item]:
    """PHP between its tags, together, and the markup around it."""
    tags = list(re.finditer(r"<\?(?:php\b|=)?([\s\S]*?)(?:\?>|\Z)", text))
    if not tags:
        return html(text)
    return code.extract("Php", mask(text, [(m.start(1), m.end(1)) for m in tags])) + html(text, [(m.start(), m.end()) for m in tags])


def blade(text: str) -> list[Item]:
    """Markup, PHP regions, directives' arguments and echoes."""
    comments = _regions(text, r"(\{\{--[\s\S]*?--\}\})")
    shown = unmask(text, comments)
    regions = _regions(shown, r"@php\b(?!\s*\()([\s\S]*?)@endphp") + _regions(shown, r"\{\{([\s\S]*?)\}\}") + _regions(shown, r"\{!!([\s\S]*?)!!\}") + _regions(shown, r"@\w+\s*(\((?:[^()]|\([^()]*\))*\))") + _regions(shown, r"<\?(?:php\b|=)([\s\S]*?)(?:\?>|\Z)")
    return _read("Php", shown, regions) + html(shown, regions)


def _scriptlets(text: str, language: str) -> list[Item]:
    tags = list(re.finditer(r"<%(#|%)?[-=_]?([\s\S]*?)[-_]?%>", text))
    code_ = [(m.start(2), m.end(2)) for m in tags if not m[1]]
    return code.extract(language, mask(text, code_)) + html(text, [(m.start(), m.end()) for m in tags])


def ejs(text: str) -> list[Item]:
    return _scriptlets(text, "JavaScript")


def erb(text: str) -> list[Item]:
    return _scriptlets(text, "Ruby")


def _braced(text: str, at: int) -> int:
    """The end of the brace block that begins at ``at``."""
    depth = 0
    for m in re.finditer(r'[{}]|"(?:[^"\\\n]|\\.)*"|//[^\n]*', text[at:]):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if not depth and m[0] == "}":
            return at + m.end()
    return len(text)


def razor(text: str) -> list[Item]:
    """C# in `@{ }`, `@code { }`, `@functions { }` and `@( )`, and the markup around it."""
    shown = unmask(text, _regions(text, r"(@\*[\s\S]*?\*@)"))
    regions = [(m.end() - 1, _braced(shown, m.end() - 1)) for m in re.finditer(r"@(?:code|functions)?\s*\{", shown)]
    regions += _regions(shown, r"@(\((?:[^()]|\([^()]*\))*\))")
    inner = [(a + 1, b - 1) if shown[a] == "{" else (a, b) for a, b in regions]
    return _read("CSharp", shown, inner) + html(shown, regions)


def _templated(text: str, comments: str, set_word: str) -> list[Item]:
    """Twig and Liquid: assignments in tags, other strings in tags and outputs as bare values, and the markup."""
    shown = unmask(text, _regions(text, comments))
    found, tags = [], list(re.finditer(r"\{%-?([\s\S]*?)-?%\}|\{\{-?([\s\S]*?)-?\}\}", shown))
    for tag in tags:
        group = 1 if tag[1] is not None else 2
        named = re.match(rf"\s*{set_word}\s+([\w.]+)\s*=", tag[group])
        for m in re.finditer(r""""((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'""", tag[group]):
            value, start = m[1] if m[1] is not None else m[2], tag.start(group) + m.start()
            key = re.search(r"([\w-]+|[\"'][\w-]+[\"'])\s*:\s*$", tag[group][: m.start()])
            name = key[1].strip("\"'") if key else named[1].rpartition(".")[2] if named and m.start() >= named.end() else None
            if value and not re.match(r"\s*:", tag[group][m.end() :]):
                found.append(Item("assignment", name, "Variable", value, start, start + len(m[0])) if name else Item("value", None, None, value, start, start + len(m[0])))
    return found + html(shown, [(m.start(), m.end()) for m in tags])


def twig(text: str) -> list[Item]:
    return _templated(text, r"(\{#[\s\S]*?#\})", "set")


def liquid(text: str) -> list[Item]:
    return _templated(text, r"(\{%-?\s*(?:comment|raw)\s*-?%\}[\s\S]*?\{%-?\s*end(?:comment|raw)\s*-?%\})", "assign")
