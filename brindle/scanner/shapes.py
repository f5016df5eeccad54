"""Predicates over candidate values. ``lower`` is a value trimmed of ASCII white space, with ASCII letters in lower case."""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
import zoneinfo
from functools import lru_cache

from brindle.functions import values

# Letter pairs that are common in English, literals that stand for no value, keyboard rows.
COMMON_PAIRS = frozenset(
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur "
    "ca el ta la ns di fo ho pe ec pr no ct us ac ot il tr ly nc et ut ss so rs un lo wa ge ie wh ee wi em ad ol rt po we na ul ni ts mo ow pa im mi ai sh "
    "qu ck ju um mp br og do".split()
)
SENTINELS = ("false", "n/a", "na", "nil", "no", "none", "null", "off", "on", "true", "undefined", "yes")
KEYBOARD_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "azertyuiop", "qsdfghjklm", "wxcvbn", "qwertzuiop", "yxcvbnm", "qzertyuiop")
RUN = 8
_UPPER = {c: c + 32 for c in range(65, 91)}
_SHAPES = {name: re.compile(pattern, re.ASCII) for name, pattern in values.SHAPES.items()}


def lowered(value: str) -> str:
    return value.strip(" \t\n\r\f").translate(_UPPER)


def entropy(lower: str) -> float:
    """Shannon entropy of the value's UTF-8 bytes, in bits each."""
    raw = lower.encode()
    return -sum(n / len(raw) * math.log2(n / len(raw)) for n in (raw.count(b) for b in set(raw)))


def alphabet_size(lower: str) -> int:
    """26 for letters, 10 for digits, one for each other distinct ASCII character."""
    others = {c for c in lower if c.isascii() and not c.isalnum()}
    return 26 * bool(re.search("[a-z]", lower)) + 10 * bool(re.search("[0-9]", lower)) + len(others)


def language_like(lower: str) -> bool:
    """Letters and word separators only, with a quarter of its letter pairs common in English."""
    if not re.fullmatch(r"[A-Za-z \-_.]*", lower):
        return False
    pairs = [w[i : i + 2] for w in re.split(r"[ \-_.]", lower) for i in range(len(w) - 1)]
    return len(pairs) >= 6 and 4 * sum(p in COMMON_PAIRS for p in pairs) >= len(pairs)


def _steps(lower: str, step: int, least: int) -> bool:
    run = 1
    for a, b in zip(lower, lower[1:]):
        run = run + 1 if a.isascii() and a.isalpha() and b.isascii() and b.isalpha() and ord(b) - ord(a) == step else 1
        if run >= least:
            return True
    return False


def alphabet_run(lower: str) -> bool:
    return _steps(lower, 1, RUN) or _steps(lower, -1, RUN)


@lru_cache(maxsize=1)
def _walks() -> frozenset[str]:
    return frozenset(row[i : i + RUN] for line in KEYBOARD_ROWS for row in (line, line[::-1]) for i in range(len(row) - RUN + 1))


def keyboard_walk(lower: str) -> bool:
    return any(w in lower for w in _walks())


def sufficient_entropy(lower: str) -> bool:
    """Eight bytes and 40 bits; 3.5 bits a byte or 85 % of what the alphabet allows; no language, alphabet or keyboard run. Hex of 40 passes."""
    n = len(lower.encode())
    if _SHAPES["pure_hex"].search(lower):
        return True
    if n < 8 or (bits := entropy(lower)) * n < 40:
        return False
    if bits < 3.5 and bits / math.log2(max(alphabet_size(lower), 2)) < 0.85:
        return False
    return not language_like(lower) and not alphabet_run(lower) and not keyboard_walk(lower)


def sequential(lower: str) -> bool:
    """Eight characters and more of one class, each the next or each the one before."""
    if len(lower) < RUN or not (re.fullmatch("[0-9]+", lower) or re.fullmatch("[A-Za-z]+", lower)):
        return False
    steps = {ord(b) - ord(a) for a, b in zip(lower, lower[1:])}
    return steps in ({1}, {-1})


def is_color(lower: str) -> bool:
    """A CSS colour: hex of 3, 4, 6 or 8 with or without #, a colour function, or a plain name of the basic set."""
    if re.fullmatch(r"#?(?:[0-9a-f]{3}|[0-9a-f]{4}|[0-9a-f]{6}|[0-9a-f]{8})", lower):
        return True
    return bool(re.fullmatch(r"(?:rgba?|hsla?|hwba?|hsva?|lab|lch|oklab|oklch)\([^()]*\)", lower)) or lower in ("transparent", "black", "silver", "gray", "white", "maroon", "red", "purple", "fuchsia", "green", "lime", "olive", "yellow", "navy", "blue", "teal", "aqua", "orange")


_CRON_FIELD = r"(?:[0-9*?LW/,#-]|[A-Za-z]{3})+"


def is_cron(value: str) -> bool:
    """Five to seven fields of numbers, steps, lists and names, or a nickname."""
    fields = value.split()
    if len(fields) == 1:
        return value.strip().lower() in ("@yearly", "@annually", "@monthly", "@weekly", "@daily", "@hourly")
    return 5 <= len(fields) <= 7 and all(re.fullmatch(_CRON_FIELD, f) for f in fields) and any(c in value for c in "*?/") or bool(re.fullmatch(r"[0-9]+(?: [0-9]+){4,6}", value.strip()) and 5 <= len(fields) <= 7)


@lru_cache(maxsize=1)
def _zones() -> frozenset[str]:
    return frozenset(z.lower() for z in zoneinfo.available_timezones())


_LOCALE = re.compile(r"(?:[a-z]{2,3}|[a-z]{5,8})(?:[-_][a-z]{4})?(?:[-_](?:[a-z]{2}|[0-9]{3}))?(?:[-_](?:[a-z0-9]{5,8}|[0-9][a-z0-9]{3}))*(?:[-_][a-wy-z0-9](?:[-_][a-z0-9]{2,8})+)*(?:[-_]x(?:[-_][a-z0-9]{1,8})+)?")


def is_locale_or_zone(lower: str) -> bool:
    """A BCP 47 tag, a POSIX locale with encoding, or an IANA time zone."""
    return bool(_LOCALE.fullmatch(lower)) or bool(re.match(r"[a-z]{2}_[a-z]{2}\.[a-z]{2}", lower)) or lower in _zones()


def is_version(lower: str) -> bool:
    return bool(_SHAPES["version"].search(lower))


def is_markup(lower: str) -> bool:
    """A numeric entity, tag, comment or declaration at the start."""
    if m := re.match(r"&#(?:x[0-9a-f]+|[0-9]+)(?=[;\s]|\Z)", lower):
        return bool(m)
    return bool(re.match(r"<(?:\?[a-z]{3}|!--|![a-z]{3}|[a-z](?:[a-z >]|\Z))", lower))


def is_datetime(value: str) -> bool:
    """An ISO date, with or without time, offset and bracketed zone and calendar."""
    return bool(re.fullmatch(r"[+-]?[0-9]{4,6}-?[0-1][0-9]-?[0-3][0-9](?:[Tt ][0-2][0-9](?::?[0-5][0-9](?::?[0-6][0-9](?:[.,][0-9]{1,9})?)?)?(?:[Zz]|[+-][0-2][0-9](?::?[0-5][0-9])?)?)?(?:\[!?[^\]]+\])*", value.strip()))


def is_email(lower: str) -> bool:
    return "." in lower.partition("@")[2] and bool(_SHAPES["email"].search(lower))


def is_template(lower: str) -> bool:
    return lower.startswith("${{") and lower.endswith("}}") and "}}" not in lower[3:-2]


def is_variable_reference(lower: str) -> bool:
    v = lower.strip()
    return any(s in v for s in ("${", "{{", "#{")) or bool(re.fullmatch(r"\$[A-Za-z0-9_]+", v))


def is_placeholder(lower: str) -> bool:
    return any(s in lower for s in values.PLACEHOLDERS)


def mixed_classes(lower: str) -> bool:
    """Two of: letters, digits, other ASCII characters."""
    return sum(bool(re.search(p, lower)) for p in ("[A-Za-z]", "[0-9]", r"[\x00-/:-@\[-`{-\x7f]")) >= 2


def secret_shape(value: str, events: frozenset[str] = frozenset()) -> bool:
    """No shape that rules a secret out."""
    lower = lowered(value)
    out = (
        lambda: any(c.isalpha() and not c.isascii() for c in lower), lambda: _SHAPES["file_path"].search(lower), lambda: is_placeholder(lower), lambda: is_markup(lower), lambda: lower in SENTINELS,
        lambda: lower in events, lambda: _SHAPES["integrity_hash"].search(lower), lambda: len(set(lower)) == 1, lambda: is_version(lower), lambda: is_email(lower), lambda: is_color(lower),
        lambda: _SHAPES["css_variable"].search(lower), lambda: is_cron(value.strip(" \t\n\r\f")), lambda: is_locale_or_zone(lower), lambda: _SHAPES["mime_type"].search(lower), lambda: is_datetime(value),
        lambda: _SHAPES["aws_arn"].search(lower), lambda: " " in lower and language_like(lower), lambda: sequential(lower), lambda: lower and not re.search("[0-9A-Za-z]", lower),
    )
    return not any(test() for test in out)


def weak_password(value: str, events: frozenset[str] = frozenset()) -> bool:
    lower = lowered(value)
    signal = re.search("[0-9]", lower) or "pass" in lower or "pwd" in lower
    return len(lower.encode()) >= 4 and not is_template(lower) and not is_variable_reference(lower) and secret_shape(value, events) and bool(signal)


def password_literal(value: str) -> bool:
    lower = lowered(value)
    return len(lower.encode()) >= 4 and not is_template(lower) and not is_variable_reference(lower) and not is_placeholder(lower) and lower not in SENTINELS


def is_card(value: str) -> bool:
    """13 to 19 digits with spaces and dashes, the first from 2 to 6, a right Luhn digit, and no published test number."""
    value = value.strip(" \t\n\r\f")
    digits = re.sub("[ -]", "", value)
    if not re.fullmatch("[2-6][0-9]{12,18}", digits) or digits in values.TEST_CARDS:
        return False
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def is_mnemonic(lower: str, wordlist: tuple[str, ...]) -> bool:
    """A BIP-39 phrase: 12 to 24 words of the list of 2048 and a right checksum. The list is the caller's."""
    found = lower.split()
    if len(wordlist) != 2048 or len(found) not in (12, 15, 18, 21, 24):
        return False
    places = {w: i for i, w in enumerate(wordlist)}
    if any(w not in places for w in found):
        return False
    bits = "".join(f"{places[w]:011b}" for w in found)
    check = len(found) // 3
    raw = int(bits[:-check], 2).to_bytes(4 * check, "big")
    return f"{hashlib.sha256(raw).digest()[0]:08b}"[:check] == bits[-check:]


def is_host(text: str) -> bool:
    try:
        ipaddress.ip_address(text.strip("[]"))
    except ValueError:
        return bool(re.fullmatch(r"[A-Za-z0-9._~%-]+", text))
    return True
