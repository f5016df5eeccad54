"""Extraction from shell scripts, on words."""

from __future__ import annotations

import re

from brindle.scanner.items import Item

_WORD = re.compile(r"""(?P<comment>(?:^|(?<=\s))#[^\n]*)|(?P<here><<-?[ \t]*(['"]?)(\w+)\3[^\n]*\n[\s\S]*?^[ \t]*\4[ \t]*$)|(?P<word>(?:"(?:[^"\\]|\\.)*"|\$?'(?:[^'\\]|\\.)*'|\$\{[^}]*\}|\$\([^()]*\)|\\[\s\S]|[^\s"';&|()<>`\\])+)|(?P<end>[\n;&|()])""", re.M)
_DEFAULT = re.compile(r"\$\{\w+(?::-|:=|:\+|-|=|\+)([^}]*)\}")


def plain(word: str) -> str:
    """A word with its quotes off; `${V:-default}` stands for its default."""
    word = _DEFAULT.sub(lambda m: m[1], word)
    return re.sub(r'''"((?:[^"\\]|\\.)*)"|\$?'((?:[^'\\]|\\.)*)'|\\([\s\S])''', lambda m: m[1].replace('\\"', '"').replace("\\$", "$") if m[1] is not None else m[2] if m[2] is not None else m[3].strip("\n"), word)


def extract(text: str) -> list[Item]:
    """Assignments as variables, array elements and all other words as bare values."""
    found: list[Item] = []
    array = None
    for m in _WORD.finditer(text):
        if m["comment"] or m["here"]:
            continue
        if m["end"]:
            array = None if m["end"] != "(" else array
            continue
        own = re.match(r"([A-Za-z_]\w*)(?:\[[^\]]*\])?\+?=", m["word"])
        if own:
            value, array = plain(m["word"][own.end() :]), own[1]
            if value:
                found.append(Item("assignment", own[1], "Variable", value, m.start() + own.end(), m.end()))
            continue
        if value := plain(m["word"]):
            found.append(Item("value", None, None, value, m.start(), m.end()))
    return found


def invocations(text: str) -> list[tuple[str, list[str]]]:
    """(name, arguments) of each simple command; assignments before it aren't part of it."""
    found: list[list[str]] = [[]]
    for m in _WORD.finditer(text):
        if m["end"]:
            found.append([])
        elif m["word"] and (found[-1] or not re.match(r"[A-Za-z_]\w*\+?=", m["word"])):
            found[-1].append(plain(m["word"]))
    return [(words[0], words[1:]) for words in found if words]
