"""Finding fingerprints: base32 of the first 10 bytes of BLAKE3(rule id, a zero byte, secret), in groups of four."""

from __future__ import annotations

import base64
import struct

import pandas as pd
from pyspark.sql import functions as F

# Fixed values of the BLAKE3 specification: the initial words, the message permutation, the flags.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_CHUNK_START, _CHUNK_END, _PARENT, _ROOT = 1, 2, 4, 8
_MASK = 0xFFFFFFFF


def _mix(v: list[int], a: int, b: int, c: int, d: int, x: int, y: int) -> None:
    for word, right, left in ((x, 16, 12), (y, 8, 7)):
        v[a] = v[a] + v[b] + word & _MASK
        v[d] ^= v[a]
        v[d] = (v[d] >> right | v[d] << 32 - right) & _MASK
        v[c] = v[c] + v[d] & _MASK
        v[b] ^= v[c]
        v[b] = (v[b] >> left | v[b] << 32 - left) & _MASK


def _compress(value, block: bytes, counter: int, flags: int) -> list[int]:
    words = list(struct.unpack("<16I", block.ljust(64, b"\0")))
    v = [*value, *_IV[:4], counter & _MASK, counter >> 32, len(block), flags]
    if flags & _PARENT:
        v[14] = 64
    for _ in range(7):
        for i in range(4):
            _mix(v, i, 4 + i, 8 + i, 12 + i, words[2 * i], words[2 * i + 1])
        for i in range(4):
            _mix(v, i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, words[8 + 2 * i], words[9 + 2 * i])
        words = [words[p] for p in _PERMUTATION]
    return [v[i] ^ v[i + 8] for i in range(8)] + [v[i + 8] ^ value[i] for i in range(8)]


def _node(data: bytes, first: int, root: int) -> list[int]:
    """The output words of the subtree over data, whose first chunk is number ``first``."""
    if len(data) <= 1024:
        blocks = [data[i : i + 64] for i in range(0, len(data), 64)] or [b""]
        value = list(_IV)
        for i, block in enumerate(blocks):
            last = i == len(blocks) - 1
            out = _compress(value, block, first, (_CHUNK_START if i == 0 else 0) | (_CHUNK_END | root if last else 0))
            value = out[:8]
        return out
    left = 1024
    while left * 2 < len(data):
        left *= 2
    sides = _node(data[:left], first, 0)[:8] + _node(data[left:], first + left // 1024, 0)[:8]
    return _compress(_IV, struct.pack("<16I", *sides), 0, _PARENT | root)


def blake3(data: bytes) -> bytes:
    return struct.pack("<16I", *_node(data, 0, _ROOT))


def fingerprint(rule_id: str, secret: str) -> str:
    raw = base64.b32encode(blake3(rule_id.encode() + b"\0" + secret.encode())[:10]).decode()
    return "-".join(raw[i : i + 4] for i in range(0, 16, 4))


def fingerprint_column(rule_id, secret):
    """As a column; only findings, which are few, pass through Python, in Arrow batches."""
    @F.pandas_udf("string")
    def computed(rules: pd.Series, secrets: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else fingerprint(r, s) for r, s in zip(rules, secrets, strict=True)])

    return computed(rule_id, secret)


def parsed(text):
    """The canonical form of a fingerprint that a user typed, or null."""
    raw = F.upper(F.regexp_replace(F.trim(text), "-", ""))
    groups = F.concat_ws("-", *[F.substring(raw, i, 4) for i in (1, 5, 9, 13)])
    return F.when(raw.rlike(r"^[A-Z2-7]{16}\z"), groups)
