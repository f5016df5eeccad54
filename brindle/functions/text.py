"""Small text functions for reports."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def article(text: Column) -> Column:
    """`an` before a vowel or a letter that is said with one, else `a`."""
    first, word = F.lower(F.substring(text, 1, 1)), F.regexp_extract(text, r"^\S+", 0)
    spelled = word.rlike("^[A-Z]{2,}$") & F.substring(text, 1, 1).isin(*"AEFHILMNORSX")
    return F.when(spelled | ~word.rlike("^[A-Z]{2,}$") & first.isin(*"aeio") | ~word.rlike("^[A-Z]{2,}$") & (first == "u") & ~F.lower(word).rlike("^(?:uni|use|uri|url|uuid)"), "an").otherwise("a")


def sanitized(text: Column) -> Column:
    """A subject without control characters, its white space runs single."""
    return F.trim(F.regexp_replace(text, r"[\x00-\x1F\x7F\s]+", " "))


def truncated(text: Column, most: int) -> Column:
    """At most so many code points, the last one an ellipsis where text is cut."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def plural(n: Column, one: str, more: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(more))


def js_access(target: Column, name: Column) -> Column:
    """A JavaScript property: `a.b` for an identifier, else `a["b c"]`."""
    quoted = F.regexp_replace(F.regexp_replace(name, r"([\\\"])", r"\\$1"), "\n", r"\\n")
    return F.when(name.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*\z"), F.concat(target, F.lit("."), name)).otherwise(F.concat(target, F.lit('["'), quoted, F.lit('"]')))


def wrapped(text: str, width: int) -> list[str]:
    """Lines of at most ``width`` code points, broken at spaces; a longer word has a line of its own."""
    lines: list[str] = []
    for word in text.split():
        if lines and len(lines[-1]) + 1 + len(word) <= width:
            lines[-1] += " " + word
        else:
            lines.append(word)
    return lines


def rendered(parts: list[tuple[str, str]], kind: str = "plain", width: int = 80) -> str:
    """Rich text of (style, text) parts (`text`, `strong`, `code`, `break`, `item`) as Markdown or as plain, wrapped text."""
    marks = {"strong": "**{}**", "code": "`{}`", "item": "- {}"} if kind == "markdown" else {"item": "* {}"}
    blocks, now = [], ""
    for style, text in parts:
        if style in ("break", "item") and now:
            blocks, now = [*blocks, now], ""
        if style == "item":
            blocks.append(marks["item"].format(text))
        elif style != "break":
            now += marks.get(style, "{}").format(text)
    blocks += [now] if now else []
    return "\n".join(blocks if kind == "markdown" else ["\n".join(wrapped(b, width)) for b in blocks])


ANY = object()


def find_all(tree, path: list) -> list:
    """The nodes of a value tree at a path of keys, in order; ``ANY`` stands for every element or member."""
    found = [tree]
    for step in path:
        found = [
            child for node in found
            for child in ((node.values() if isinstance(node, dict) else node if isinstance(node, list) else ()) if step is ANY else [node[step]] if isinstance(node, dict) and step in node else ())
        ]
    return found


