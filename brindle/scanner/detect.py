"""Content detectors: key blocks, Rails keys, and binary key stores by their first bytes."""

from __future__ import annotations

import re

from brindle.scanner.verdicts import PEM, PUTTY, PUTTY_KINDS, pem_label

# Object identifiers of key algorithms and of OpenPGP ones.
KEY_ALGORITHMS = {"1.2.840.113549.1.1.1": "RSA", "1.2.840.10045.2.1": "EC", "1.3.101.112": "Ed25519", "1.3.101.113": "Ed448", "1.3.101.110": "X25519", "1.3.101.111": "X448", "1.2.840.113549.1.3.1": "DH", "1.2.840.10040.4.1": "DSA"}
PGP_ALGORITHMS = {
    1: "RSA", 2: "RSA", 3: "RSA", 16: "ElGamal", 17: "DSA", 18: "ECDH", 19: "ECDSA", 22: "EdDSA", 25: "X25519", 26: "X448", 27: "Ed25519", 28: "Ed448", 30: "ML-DSA-65+Ed25519", 31: "ML-DSA-87+Ed448",
    32: "SLH-DSA-SHAKE-128s", 33: "SLH-DSA-SHAKE-128f", 34: "SLH-DSA-SHAKE-256s", 35: "ML-KEM-768+X25519", 36: "ML-KEM-1024+X448",
}
PGP_TIMES = (662680799, 4102444800)


def rails_key(path: str, text: str) -> str | None:
    """The key of `master.key` or `config/credentials/*.key`: 32 hex digits and nothing else."""
    named = re.search(r"(?:^|/)master\.key$|(?:^|/)config/credentials/[^/]*\.key$", path, re.I)
    own = text.strip()
    return own if named and re.fullmatch("[0-9A-Fa-f]{32}", own) else None


def key_blocks(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, description, start, end) of PEM blocks whose labels agree and of PuTTY files, in order."""
    found = [("PrivateKey", pem_label(m[1]), m.start(), m.end()) for m in PEM.finditer(text) if m[1] == m[2]]
    found += [("PuttyKey", f"PuTTY {PUTTY_KINDS.get(m[2], '')}private key", m.start(), m.end()) for m in PUTTY.finditer(text)]
    return sorted(found, key=lambda f: f[2:])


def only_filler(text: str, blocks: list[tuple[str, str, int, int]]) -> bool:
    """Whether nothing but blank lines, comments and header lines stands around the blocks."""
    rest, at = [], 0
    for *_, start, end in blocks:
        rest.append(text[at:start])
        at = end
    lines = "\n".join([*rest, text[at:]]).split("\n")
    return all(not line.strip() or line.lstrip().startswith("#") or re.match(r"[A-Za-z][\w .-]*:", line.strip()) for line in lines)


def in_base64(text: str, start: int, end: int) -> bool:
    """Whether a hit has a neighbour `+` or `/`, unless it lies in a web URL's path, query or fragment."""
    if text[start - 1 : start] not in ("+", "/") and text[end : end + 1] not in ("+", "/"):
        return False
    stop = re.compile(r"""[^\x21-\x7e]|["'`<>\\^{}|]""")
    left = max((m.end() for m in stop.finditer(text, max(0, start - 4096), start)), default=max(0, start - 4096))
    right = m.start() if (m := stop.search(text, end)) else len(text)
    own = re.fullmatch(r"[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(.*)", text[left:right])
    return not (own and text[start:end] in own[1])


def _tlv(raw: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, begin, end) of the DER element at a place."""
    if at + 2 > len(raw):
        return None
    size, begin = raw[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or begin + n > len(raw):
            return None
        size, begin = int.from_bytes(raw[begin : begin + n], "big"), begin + n
    return raw[at], begin, begin + size


def _oid(raw: bytes) -> str:
    parts, value = [], 0
    for b in raw:
        value = value << 7 | b & 0x7F
        if not b & 0x80:
            parts, value = [*parts, value], 0
    first = parts[0] if parts else 0
    top = min(first // 40, 2)
    return ".".join(map(str, [top, first - 40 * top, *parts[1:]]))


def der(raw: bytes) -> str | None:
    """PKCS#12, PKCS#8 with its algorithm, or a PKCS#1 RSA key."""
    if len(raw) < 12 or raw[0] != 0x30 or raw[1] in (0x80, 0xFF):
        return None
    whole = _tlv(raw, 0)
    version = whole and _tlv(raw, whole[1])
    if not version or version[0] != 0x02 or version[2] - version[1] != 1:
        return None
    number, after = raw[version[1]], _tlv(raw, version[2])
    if number == 3:
        return "PKCS#12 key store" if after and after[0] == 0x30 else None
    if number not in (0, 1) or not after or whole[2] > len(raw):
        return None
    if after[0] == 0x30:  # the algorithm, then the key as an octet string
        oid, key = _tlv(raw, after[1]), _tlv(raw, after[2])
        if oid and oid[0] == 0x06 and key and key[0] == 0x04 and key[2] <= len(raw):
            name = KEY_ALGORITHMS.get(_oid(raw[oid[1] : oid[2]]), "")
            return f"PKCS#8 {name} private key".replace("  ", " ")
        return None
    at, integers = version[2], 0
    while at < whole[2] and (part := _tlv(raw, at)) and part[0] == 0x02 and part[2] <= len(raw):
        at, integers = part[2], integers + 1
    return "PKCS#1 RSA private key" if number == 0 and integers == 8 and at == whole[2] else None


def pgp(raw: bytes) -> str | None:
    """An OpenPGP secret key or subkey packet, version 4 or 5, with a plausible time and a known algorithm."""
    if not raw:
        return None
    old = {0x94: ("secret key", 2), 0x95: ("secret key", 3), 0x96: ("secret key", 5), 0x9C: ("secret subkey", 2), 0x9D: ("secret subkey", 3), 0x9E: ("secret subkey", 5)}
    if raw[0] in old:
        kind, at = old[raw[0]]
    elif raw[0] in (0xC5, 0xC7) and len(raw) > 1:
        kind, at = ("secret key" if raw[0] == 0xC5 else "secret subkey"), 2 if raw[1] < 192 or 224 <= raw[1] < 255 else 3 if raw[1] < 224 else 6
    else:
        return None
    if len(raw) <= at or raw[at] not in (4, 5) or len(raw) < at + (6 if raw[at] == 4 else 10) or not PGP_TIMES[0] <= int.from_bytes(raw[at + 1 : at + 5], "big") <= PGP_TIMES[1]:
        return None
    name = PGP_ALGORITHMS.get(raw[at + (5 if raw[at] == 4 else 9)])
    return f"GPG/PGP {name} {kind}" if name else None


def store(raw: bytes) -> str | None:
    """JKS, JCEKS and KeePass files by their magic numbers."""
    if raw[:4] in (b"\xfe\xed\xfe\xed", b"\xce\xce\xce\xce") and len(raw) >= 12:
        right = int.from_bytes(raw[4:8], "big") in (1, 2) and int.from_bytes(raw[8:12], "big") >= 1
        return ("JKS key store" if raw[:1] == b"\xfe" else "JCEKS key store") if right else None
    if raw[:4] == b"\x03\xd9\xa2\x9a":
        if raw[4:8] == b"\x65\xfb\x4b\xb5":
            return "KeePass KDB database"
        if raw[4:8] == b"\x67\xfb\x4b\xb5" and len(raw) >= 12:
            return {3: "KeePass KDBX 3 database", 4: "KeePass KDBX 4 database"}.get(int.from_bytes(raw[10:12], "little"))
    return None


def binary(raw: bytes) -> str | None:
    """What secret store a file is by its first byte's detector."""
    return {0x30: der, 0xFE: store, 0xCE: store, 0x03: store}.get(raw[0], pgp)(raw) if raw else None
