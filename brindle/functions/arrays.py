"""Running totals over arrays, inside the row, as SQL expressions (a long expression is one call to the JVM this way)."""

from __future__ import annotations

from collections.abc import Callable

#: Items of a block. A block's totals are appended one by one, and so are the blocks' own.
BLOCK = 128


def let(name: str, value: str, body: str) -> str:
    """``body``, in which ``name`` stands for a value that is evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def running(items: str, kind: str, value: Callable[[str], str], join: Callable[[str, str], str], zero: int) -> str:
    """Structs (before, item): each item of an array with the joined int values of all items before it.

    ``kind`` is the items' type. Appending to an array copies it, so totals are taken within
    blocks and then over the blocks: the copies grow as the items times ``BLOCK``, not as their square.
    """
    empty = f"CAST(array() AS ARRAY<STRUCT<before: INT, item: {kind}>>)"
    step = f"named_struct('total', {join('s.total', value('x'))}, 'out', concat(s.out, array(named_struct('before', s.total, 'item', x))))"
    within = f"aggregate(slice(held, block * {BLOCK} + 1, {BLOCK}), named_struct('total', {zero}, 'out', {empty}), (s, x) -> {step})"
    blocks = f"transform(sequence(0, CAST(floor((size(held) - 1) / {BLOCK}) AS INT)), block -> {within})"
    starts = f"aggregate(blocks, named_struct('total', {zero}, 'out', CAST(array() AS ARRAY<INT>)), (s, b) -> named_struct('total', {join('s.total', 'b.total')}, 'out', concat(s.out, array(s.total)))).out"
    joined = f"flatten(zip_with(blocks, {starts}, (b, t) -> transform(b.out, o -> named_struct('before', {join('t', 'o.before')}, 'item', o.item))))"
    return let("held", items, f"CASE WHEN size(held) > 0 THEN {let('blocks', blocks, joined)} ELSE {empty} END")


def literal(text: str) -> str:
    """A SQL string literal of Spark, whose backslashes stand for themselves."""
    return "r'" + text + "'" if "'" not in text else 'r"' + text + '"' if '"' not in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
