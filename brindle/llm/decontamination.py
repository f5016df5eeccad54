"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items become windows of 13 words (a shorter item is one window); all windows go
into one automaton over normalised text, which every document passes once. Matches are
mapped back to the document's words and to code-point offsets in the original text. A
benchmark of more than ``BLOCK_BYTES`` is taken in blocks of about that size: documents of
``HELD_BYTES`` together pass an automaton per block and each row carries its marked words
along, without a shuffle. More than ``GROUP_BYTES`` are broadcast in groups, one after the other.

Defined results: null and empty texts have no words and are never contaminated; items
without words are never found; repeated windows and items count once per item id; benchmark rows
with a null id are found too, count as one item together and have no part in items_sha256;
documents' null ids are kept; an empty documents table gives an empty one and an empty benchmark marks nothing;
other columns are ignored by ``mark`` and kept by ``drop_contaminated``, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import shared

WINDOW = 13
#: Benchmark text of one automaton, in characters: some 500 bytes of memory each.
BLOCK_BYTES = 400_000
#: Benchmark text that is broadcast at once, in bytes.
GROUP_BYTES = 32_000_000
#: Documents that pass the automata of several blocks together, in bytes.
HELD_BYTES = 32_000_000
_KEEP = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
_TABLE = bytes(b if b in _KEEP else 32 for b in bytes(range(256)).lower())


def words(raw: bytes) -> list[bytes]:
    """The lower-cased words of UTF-8 text."""
    return raw.translate(_TABLE).split()


def _ordered(ids: set[str | None]) -> list[str | None]:
    return sorted(ids, key=lambda i: (i is None, i or ""))


def windows(items: list[tuple[str | None, str]], size: int = WINDOW) -> dict[str, tuple[int, tuple[str, ...]]]:
    """Each distinct window's text, its word count and the items that hold it."""
    found: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        own = words((text or "").encode())
        for at in range(max(1, len(own) - size + 1) if own else 0):
            part = own[at : at + size]
            found.setdefault(f" {b' '.join(part).decode('latin-1')} ", (len(part), set()))[1].add(item)
    return {k: (n, tuple(_ordered(ids))) for k, (n, ids) in found.items()}


def automaton(found: dict[str, tuple[int, tuple[str, ...]]]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for window, value in found.items():
        made.add_word(window, value)
    made.make_automaton()
    return made


def hits(raw: bytes, machine) -> tuple[int, np.ndarray | None, set[str]]:
    """Word count, the marked words (None if there are none) and the items found."""
    own = words(raw)
    text = f" {b' '.join(own).decode('latin-1')} "
    spaces, steps, items = None, None, set()
    for end, (size, ids) in machine.iter(text) if own and len(machine) else ():
        if spaces is None:
            spaces = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
            steps = np.zeros(len(own) + 1, np.int32)
        last = int(np.searchsorted(spaces, end))
        steps[last - size] += 1
        steps[last] -= 1
        items.update(ids)
    return len(own), None if steps is None else np.cumsum(steps[:-1]) > 0, items


def spans(raw: bytes, marked: np.ndarray) -> str:
    """The marked runs of words as start:end code points of the original text."""
    flat = np.frombuffer(raw.translate(_TABLE), np.uint8) != 32
    edges = np.diff(np.concatenate([[0], flat.view(np.int8), [0]]))
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    runs = np.diff(np.concatenate([[0], marked.view(np.int8), [0]]))
    firsts, lasts = np.flatnonzero(runs == 1), np.flatnonzero(runs == -1) - 1
    return ",".join(f"{points[begins[a]]}:{points[ends[b]]}" for a, b in zip(firsts, lasts, strict=True))


def longest_run(marked: np.ndarray) -> int:
    """The most marked words in a row."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.view(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max(initial=0))


def _bits(mask: bytes | None, n: int) -> np.ndarray | None:
    """A packed mask's first n bits."""
    return None if mask is None else np.unpackbits(np.frombuffer(mask, np.uint8))[:n].astype(bool)


def _groups(spark: SparkSession, benchmark: DataFrame, id_col: str, text_col: str):
    """Broadcast items of each group, dealt into blocks; a group's size is bounded before it is fetched."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.coalesce(text_col, F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // GROUP_BYTES)
    for k in range(n):
        blocks, size = [[]], 0
        for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).toLocalIterator():
            if size > BLOCK_BYTES:
                blocks, size = [*blocks, []], 0
            blocks[-1].append((r["item"], r["text"]))
            size += len(r["text"])
        yield uuid.uuid4().hex, spark.sparkContext.broadcast(blocks)


def _kept_along(frame, raws, masks, items, counts):
    import pyarrow as pa

    arrays = [*frame.columns[:-3], pa.array(masks, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(counts, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, schema=frame.schema)


def _pass(name: str, group, text_at: int, finish):
    """An Arrow function that adds a group's marks to the last columns, `mask`, `items` and `n`, and hands them to ``finish``.

    A worker holds one block's automaton at a time, and keeps it where there is no other block.
    """

    def passed(held):
        raws = [[(t or "").encode() for t in frame.column(text_at).to_pylist()] for frame in held]
        masks, items = ([frame.column(frame.num_columns - k).to_pylist() for frame in held] for k in (3, 2))
        counts = [[0] * len(own) for own in raws]
        for number, block in enumerate(group.value):
            machine = shared.remembered(("automaton", name, number), lambda b=block: automaton(windows(b)))
            for i, own in enumerate(raws):
                for at, raw in enumerate(own):
                    counts[i][at], marked, found = hits(raw, machine)
                    if marked is not None:
                        if masks[i][at] is not None:
                            marked |= _bits(masks[i][at], len(marked))
                        masks[i][at] = np.packbits(marked).tobytes()
                        items[i][at] += _ordered(found)
        for each in zip(held, raws, masks, items, counts, strict=True):
            yield finish(*each)

    def run(frames):
        held, size = [], 0
        for frame in frames:
            held.append(frame)
            size += frame.nbytes
            if len(group.value) < 2 or size >= HELD_BYTES:  # one automaton stays; several are built anew for what is held
                yield from passed(held)
                held, size = [], 0
        if held:
            yield from passed(held)

    return run


def _marked(spark: SparkSession, rows: DataFrame, text_col: str, benchmark: DataFrame, bench_id: str, bench_text: str, finish, schema) -> DataFrame:
    """What ``finish`` makes of the batches of ``rows`` and their marks, in the worker that finds them."""
    at = rows.columns.index(text_col)
    wide = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))]).withColumns({"mask": F.lit(None).cast("binary"), "items": F.array().cast("array<string>"), "n": F.lit(None).cast("long")})
    groups = [*_groups(spark, benchmark, bench_id, bench_text)] or [("none", spark.sparkContext.broadcast([[]]))]
    for number, (name, group) in enumerate(groups):
        if number + 1 == len(groups):
            return wide.mapInArrow(_pass(name, group, at, finish), schema)
        # written, or the groups' workers would all run at once
        wide = shared.written(wide.mapInArrow(_pass(name, group, at, _kept_along), wide.schema), f"{shared.work_dir(spark, 'decontamination')}/{number}")


def mark(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", bench_id: str = "item_id", bench_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (marked runs as code points of the text)."""

    def result(frame, raws, masks, all_items, counts):
        import pyarrow as pa

        rows = []
        for raw, mask, items, n in zip(raws, masks, all_items, counts, strict=True):
            marked = _bits(mask, n)
            n_hit, ids = 0 if marked is None else int(marked.sum()), _ordered(set(items))
            rows.append((n, n_hit, len(ids), hashlib.sha256(",".join(i for i in ids if i is not None).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n, "" if marked is None else spans(raw, marked)))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([frame.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string"
    return _marked(spark, rows, "text", benchmark, bench_id, bench_text, result, schema)


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text_col: str = "text", bench_id: str = "item_id", bench_text: str = "text") -> DataFrame:
    """The rows without benchmark passages, with all their columns.

    A row goes when ``WINDOW`` words in a row are marked, in a text of any length, or when it is
    contaminated by ``mark``'s rule. So a short item alone, which ordinary prose may hold by
    chance, removes only a row that it makes up a twentieth of.
    """

    def clean(frame, raws, masks, items, counts):
        import pyarrow as pa

        marks = [_bits(mask, n) for mask, n in zip(masks, counts, strict=True)]
        keep = [m is None or not (longest_run(m) >= WINDOW or 20 * int(m.sum()) >= n) for m, n in zip(marks, counts, strict=True)]
        return frame.filter(pa.array(keep, pa.bool_())).select(range(frame.num_columns - 3))

    wide = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return _marked(spark, docs, text_col, benchmark, bench_id, bench_text, clean, wide.schema).toDF(*docs.columns)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return mark(spark, read("documents"), read("benchmark")).drop("spans")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP8_SQL = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS k, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS win
         FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM wins),
grams AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
          FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs CROSS JOIN sizes WHERE len(w) >= k)),
found AS (SELECT doc_id, i, k, item FROM grams JOIN wins USING (win, k)),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)
"""
