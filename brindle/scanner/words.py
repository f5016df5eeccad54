"""Identifiers: splitting into words, and telling credential names from others."""

from __future__ import annotations

import re
from dataclasses import dataclass

from brindle.functions import names
from brindle.sources.services import SERVICES

# Words that end a password field's name, and phrases that qualify a key.
PASSWORD_ENDS = ("pass", "passphrase", "passwd", "password", "pwd")
KEY_PHRASES = ("logged_in",)
_BY_KEYWORD = {s[0]: s for s in SERVICES}
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_DIGITS = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
_QUALIFIED = frozenset(names.KEY_QUALIFIERS + names.TOKEN_QUALIFIERS + names.STRONG_KEYWORDS)


def camel_words(part: str) -> list[str]:
    """Lower-case words of one camel-case part. Digits part words where that happens at most twice."""
    cuts = {m.start() for m in _CAMEL.finditer(part)}
    digits = {m.start() for m in _DIGITS.finditer(part)}
    cuts = sorted(cuts | digits if len(digits) <= 2 else cuts)
    return [part[a:b].lower() for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True) if part[a:b]]


def name_words(name: str) -> list[str]:
    """Words of an identifier: parted at `_`, `-`, `.` and `/`, then at camel-case borders."""
    return [w for part in re.split(r"[_\-./]", name.strip()) if part for w in camel_words(part)]


def compound(word: str) -> list[str]:
    """`apikey` as `api`, `key`: a credential word with a qualifier before it."""
    for end in (*names.STRONG_KEYWORDS, "key", "token"):
        if word.endswith(end) and word[: -len(end)] in _QUALIFIED:
            return [word[: -len(end)], end]
    return [word]


def context_words(found: list[str]) -> list[str]:
    """Words of five ASCII letters and more: they count as known words beside the name."""
    return [w for w in found if len(w) >= 5 and w.isascii() and w.isalpha()]


@dataclass(frozen=True)
class NameClass:
    kind: str  # Sensitive, Key, Token or Mnemonic
    weak: bool = False
    service: tuple | None = None
    words: tuple[str, ...] = ()


def is_password_name(name: str) -> bool:
    found = name_words(name)
    return bool(found) and found[-1] in PASSWORD_ENDS and not set(found) & set(names.EXCLUSIONS)


def classify(name: str) -> NameClass | None:
    """What credential a name stands for, or None."""
    found = [w for word in name_words(name) for w in compound(word)]
    have = set(found)
    if not found or have & set(names.DISQUALIFIERS):
        return None
    if "nonce" in have and not (found[found.index("nonce") + 1 :][:1] or [""])[0] in names.NONCE_FOLLOWERS:
        return None
    services = [w for w in found if w in _BY_KEYWORD]
    if any(w in names.EXCLUSIONS and w not in _BY_KEYWORD for w in found):
        return None
    service = _BY_KEYWORD[services[-1]] if services else None
    key = "key" in have and not have & set(names.KEY_DISQUALIFIERS)
    token = "token" in have and not have & set(names.TOKEN_DISQUALIFIERS)
    if "mnemonic" in have:
        return NameClass("Mnemonic", service=service)
    kind, weak = _kind(found, key, token, service)
    if kind is None:
        return None
    return NameClass(kind, weak, service, tuple(context_words(found)))


def _kind(found: list[str], key: bool, token: bool, service) -> tuple[str | None, bool]:
    joined, last = "_".join(found), found[-1]
    if joined == "auth" or any(p in joined for p in names.STRONG_PHRASES):
        return "Sensitive", False
    if any(p in joined for p in names.WEAK_PHRASES):
        return "Sensitive", True
    bare = {"Key": last == "key" and not service and not set(found) & set(names.KEY_QUALIFIERS), "Token": last == "token" and not service and not set(found) & set(names.TOKEN_QUALIFIERS)}
    kind = None
    for word in found:
        if word in names.STRONG_KEYWORDS:
            kind = "Sensitive"
        elif key and word in names.KEY_QUALIFIERS:
            kind = "Key"
        elif token and word in names.TOKEN_QUALIFIERS:
            kind = "Token"
        if kind:
            break
    if not kind and key and any(p in joined for p in KEY_PHRASES):
        kind = "Key"
    if not kind and service and last in ("key", "token"):
        kind = last.capitalize()
    if not kind and not service:
        kind = "Key" if key and last == "key" else "Token" if token and last == "token" else None
    return kind, bool(kind and {"Key": key, "Token": token}.get(kind) and bare[kind])
