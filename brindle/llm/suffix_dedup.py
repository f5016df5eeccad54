"""Substring deduplication with suffix arrays built by two-stage sorting.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere in the corpus
is removed. The corpus is too large for one suffix array, so equal strings are first
brought together: the minimizer of a string (the leftmost least hash of its ``GRAM``-byte
grams) depends on its bytes alone, so equal strings have equal minimizers at equal places.
The starts whose strings share one minimizer occurrence form a run; the bytes that a run's
strings cover are its context.

* texts that occur twice and have LENGTH bytes are removed whole; others count once;
* a minimizer that occurs once covers no repeated string;
* equal contexts of one minimizer are repeated from end to end;
* different contexts of one minimizer, one of each kind, are sorted: suffixes smaller than
  their successors directly, all others induced by scanning the buckets, and neighbours
  among the starts that share LENGTH bytes are repeated.

Strings of up to ``RANKED`` bytes are ranked by doubling, so that the direct sort and the
common prefixes compare ranks and not bytes. A task sorts about ``SORT_BYTES`` at a time. The
contexts of a hot minimizer, which together exceed ``GROUP_BYTES``, are split into slabs of
``SLABS`` starts before the shuffle, by the bytes that all strings of a slab share; a slab is
sorted like a minimizer's contexts. Slabs of one start are strings: a group of any size is
counted there, with the counts combined before the shuffle, and nothing is left to sort.

Defined results: a null text is the empty text; texts shorter than LENGTH lose nothing;
null and repeated ids are rows like any other; an empty table gives an empty table; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import shared

LENGTH = 400
GRAM = 64
#: Bytes of the longest strings that are ranked by doubling before they are sorted.
RANKED = 64
#: A task sorts about so many bytes at a time, and the contexts of one minimizer meet in a task up to so many.
SORT_BYTES = 1_000_000
GROUP_BYTES = 1_500_000
#: Offsets of a slab, for the minimizers beyond and for their slabs that are still beyond.
SLABS = (32, 1)
_PRIME = 0x9E3779B97F4A7C15


def _grams(raw: bytes, gram: int) -> np.ndarray:
    """A hash of each gram (a power of two of bytes), by doubling."""
    h = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    size, factor = 1, _PRIME
    while size < gram:
        h = h[: len(h) - size] * np.uint64(factor) + h[size:]
        size, factor = 2 * size, factor * factor & (1 << 64) - 1
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def minimizers(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first start, last start) of each run of starts with one minimizer occurrence."""
    n = len(raw)
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = _grams(raw, gram)
    width, m = length - gram + 1, len(h)
    # Least of each window of `width` values: suffix minima of one block and prefix minima of the next.
    short = (h >> np.uint64(24) << np.uint64(24)) | (np.arange(m, dtype=np.uint64) & np.uint64(0xFFFFFF)) if m < 1 << 24 else None
    if short is None:  # a text of over 16 MB: parts that overlap by a string less one byte
        step = (1 << 24) - 1 - length
        parts = []
        for at in range(0, n - length + 1, step):
            hh, a, b = minimizers(raw[at : at + step + length - 1], length, gram)
            parts.append((hh, a + at, b + at))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    pad = -m % width
    blocks = np.concatenate([short, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, width)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - length + 1)
    best = np.minimum(suffix[starts], prefix[starts + width - 1])
    place = (best & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return h[place[first]], first, np.append(first[1:], len(starts)) - 1


def _in_order(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of at most ``bits`` bits in order, and the place that each had."""
    b = max(1, len(keys).bit_length())
    if bits + b <= 64:  # key and place in one number: sorting numbers is several times as fast as sorting places
        packed = np.sort(keys << np.uint64(b) | np.arange(len(keys), dtype=np.uint64))
        return packed >> np.uint64(b), (packed & np.uint64((1 << b) - 1)).astype(np.int64)
    by = np.argsort(keys, kind="stable")
    return keys[by], by


def string_ranks(text: np.ndarray, depth: int = LENGTH) -> dict[int, np.ndarray]:
    """For 2, 4, ... ``RANKED`` bytes: the rank of the string at each place, with zeros after the end."""
    found = np.concatenate([text, np.zeros(depth + RANKED, np.uint8)]).astype(np.uint64)
    found = found << np.uint64(8) | np.append(found[1:], np.uint64(0))
    ranks, size, bits = {2: found}, 2, 16
    while size < RANKED:
        keys, places = _in_order(found << np.uint64(bits) | np.append(found[size:], np.full(size, found[-1])), 2 * bits)
        found = np.empty(len(keys), np.uint64)
        found[places] = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]])).astype(np.uint64)
        size, bits = 2 * size, max(1, int(found.max()).bit_length())
        ranks[size] = found
    return ranks


def _stretches(depth: int) -> list[tuple[int, int]]:
    """(offset, size) of the ranked strings that make up the first ``depth`` (an even number of) bytes."""
    found, at = [], 0
    while at < depth:
        size = RANKED
        while size > depth - at:
            size //= 2
        found.append((at, size))
        at += size
    return found


def suffix_order(text: np.ndarray, depth: int = LENGTH, ranks: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """All suffixes in the order of their first ``depth`` bytes, by two-stage sorting."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    ranks = string_ranks(text, depth) if ranks is None else ranks
    nxt = np.append(text[1:].astype(np.int16), -1)
    differs = text != nxt
    turn = np.where(differs, np.arange(n), n)  # the first place from here on where the next byte differs
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    small = (text < nxt)[turn]  # the suffix is smaller than its successor
    order = np.flatnonzero(small)
    group = np.zeros(len(order), np.uint64)
    active = np.arange(len(order))
    for at, size in _stretches(depth):
        if not len(active):
            break
        own = ranks[size]
        bits = max(1, int(own.max()).bit_length())
        keys, by = _in_order(group[active] << np.uint64(bits) | own[order[active] + at], bits + len(order).bit_length())
        order[active] = order[active][by]  # groups are contiguous and stay where they are
        fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
        group[active] = active[np.maximum.accumulate(np.where(fresh, np.arange(len(active)), 0))].astype(np.uint64)
        active = active[~(fresh & np.append(fresh[1:], True))]
    sizes, n_direct = np.bincount(text, minlength=256), np.bincount(text[order], minlength=256)
    ends = np.cumsum(sizes)
    head = (ends - sizes).tolist()
    out = np.full(n, -1, np.int64)
    tails = ends - n_direct
    if len(order):
        first = text[order]
        begin = np.cumsum(n_direct) - n_direct
        out[tails[first] + np.arange(len(order)) - begin[first]] = order

    def induce(sources: np.ndarray) -> None:
        """Puts the larger suffixes before the given ones at the heads of their buckets, in order."""
        before = sources[sources > 0] - 1
        before = before[~small[before]]
        if len(before):
            letters = text[before]
            by = np.argsort(letters, kind="stable")
            before, letters = before[by], letters[by]
            cuts = np.flatnonzero(np.concatenate([[True], letters[1:] != letters[:-1]]))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(before)], strict=True):
                c = int(letters[a])
                out[head[c] : head[c] + b - a] = before[a:b]
                head[c] += b - a

    induce(np.array([n]))
    for c in np.flatnonzero(sizes).tolist():
        done = int(ends[c] - sizes[c])
        while done < head[c]:  # a run of one byte fills its own bucket in waves
            stop = head[c]
            induce(out[done:stop])
            done = stop
        induce(out[tails[c] : ends[c]])
    return out


def common_prefixes(order: np.ndarray, ranks: dict[int, np.ndarray], depth: int = LENGTH) -> np.ndarray:
    """Whether each suffix of the order shares its first ``depth`` bytes with the one before."""
    same = np.zeros(len(order), bool)
    active = np.arange(1, len(order))
    for at, size in _stretches(depth):
        active = active[ranks[size][order[active] + at] == ranks[size][order[active - 1] + at]]
    same[active] = True
    return same


def repeated_starts(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each context, the starts whose strings also start elsewhere in the contexts."""
    text = np.frombuffer(b"\0".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    begins = np.cumsum(sizes + 1) - sizes - 1
    valid = np.zeros(len(text), bool)
    for b, size in zip(begins.tolist(), sizes.tolist(), strict=True):
        valid[b : b + size - length + 1] = True
    ranks = string_ranks(text, length)
    order = suffix_order(text, length, ranks)
    order = order[valid[order]]
    same = common_prefixes(order, ranks, length)
    hit = np.zeros(len(text), bool)
    hit[order[same | np.append(same[1:], False)]] = True
    return [np.flatnonzero(hit[b : b + max(0, size - length + 1)]) for b, size in zip(begins.tolist(), sizes.tolist(), strict=True)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((begin, end))
    return out


def slabs(raw: bytes, hashed: int, first: int, last: int, size: int) -> list[tuple[int, int, int, int]]:
    """(key, context, first, last) of a run's starts in slabs of ``size`` offsets from the minimizer.

    The key is a digest of the minimizer, the slab and the bytes that all strings of the slab
    have in common, so equal strings have equal keys. Slabs of one start are whole strings.
    """
    place = first + int(np.flatnonzero(_grams(raw[first : first + LENGTH], GRAM).view(np.int64) == hashed)[0])
    digest = lambda *parts: int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)
    found, start, low = [], first, place - (LENGTH - GRAM)  # a string holds its minimizer, so no start is before
    while start <= last:
        slab = (start - low) // size
        begin, stop = low + slab * size, min(last, low + slab * size + size - 1)
        key = digest(hashed.to_bytes(8, "little", signed=True), slab.to_bytes(2, "little"), raw[begin + size - 1 : begin + LENGTH])
        found.append((key, digest(raw[start : stop + LENGTH]), start, stop))
        start = stop + 1
    return found


def _runs(rows: DataFrame) -> DataFrame:
    """(digest, n, hashes, contexts, firsts, lasts) of rows (digest, text)."""

    def run(frames):
        import pyarrow as pa

        for frame in frames:
            for first in range(0, frame.num_rows, 500):
                part, table = frame.slice(first, 500), []
                for digest, text in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    raw = text.encode()
                    hashes, a, b = minimizers(raw)
                    marks = [int.from_bytes(hashlib.blake2b(raw[i : j + LENGTH], digest_size=8).digest(), "little", signed=True) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
                    table.append((digest, len(raw), hashes.view(np.int64), marks, a, b))
                columns = list(zip(*table, strict=True))
                kinds = (pa.binary(), pa.int64(), *[pa.list_(pa.int64())] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["digest", "n", "hashes", "contexts", "firsts", "lasts"])

    return rows.mapInArrow(run, "digest binary, n long, hashes array<long>, contexts array<long>, firsts array<long>, lasts array<long>")


def _cut(frames):
    """Contexts' bytes, from rows (text, wanted: structs of hash, first, last, digest)."""
    import pyarrow as pa

    for frame in frames:
        for first in range(0, frame.num_rows, 200):
            part, table = frame.slice(first, 200), []
            for text, wanted in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist(), strict=True):
                raw = text.encode()
                table += [(w["hash"], w["digest"], w["first"], w["alone"], raw[w["first"] : w["last"] + LENGTH]) for w in wanted]
            columns = list(zip(*table, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["hash", "digest", "first", "alone", "context"])


def _slabbed(size: int):
    """Slabs of the wanted runs, from rows (text, wanted)."""

    def run(frames):
        import pyarrow as pa

        for frame in frames:
            for text, wanted in zip(frame.column("text"), frame.column("wanted"), strict=True):
                raw, table = text.as_py().encode(), []
                for w in wanted.as_py():
                    table += [(w["digest"], w["gram"], *slab, w["alone"]) for slab in slabs(raw, w["gram"], w["first"], w["last"], size)]
                columns = list(zip(*table, strict=True)) or [[]] * 7
                kinds = (pa.binary(), *[pa.int64()] * 5, pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["digest", "gram", "hash", "context", "first", "last", "alone"])

    return run


def _sorted_contexts(frames):
    """(digest, begin, end) removed runs, from contexts that come ordered by hash."""
    import pyarrow as pa

    held: list[tuple] = []  # (hash, digest, first, alone, context)

    def resolve():
        out = []
        for (_, digest, first, alone, _), starts in zip(held, repeated_starts([r[4] for r in held]), strict=True):
            if alone and len(starts):
                out += [(digest, first + b, first + e) for b, e in merged([(s, s + LENGTH) for s in starts.tolist()])]
        columns = list(zip(*out, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int64()), strict=True)], ["digest", "begin", "end"])

    size = 0
    for frame in frames:
        for row in zip(*[c.to_pylist() for c in frame.columns], strict=True):
            if held and size >= SORT_BYTES and row[0] != held[-1][0]:
                yield resolve()
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield resolve()


def _texts_of(rows: DataFrame, kinds: DataFrame, at: str) -> DataFrame:
    """(text, wanted) of the texts that represent the kinds (hash, n, alone, one): each once, however many rows repeat it."""
    wanted = kinds.select(F.col("one.digest").alias("digest"), F.struct("hash", "one.gram", F.col("one.digest").alias("digest"), F.col("one.first").alias("first"), F.col("one.last").alias("last"), "alone").alias("w"))
    wanted = shared.written(wanted.groupBy("digest").agg(F.collect_list("w").alias("wanted")), at)  # of one text
    if wanted.count() * 80 <= shared.BROADCAST_BYTES:
        rows = rows.join(F.broadcast(wanted.select("digest")), "digest", "left_semi")
    return rows.groupBy("digest").agg(F.first("text").alias("text")).join(wanted, "digest").select("text", "wanted")


def _resolved(spark: SparkSession, rows: DataFrame, each: DataFrame, at: str, sizes: tuple[int, ...]) -> list[DataFrame]:
    """(digest, begin, end) frames for the runs ``each`` (digest, gram, hash, context, first, last, alone); gram is their minimizer, hash what brings them together."""
    kinds = each.groupBy("hash", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("digest", "first", "last", "alone", "gram")).alias("one"))
    kinds = shared.written(kinds.withColumn("alone", (F.col("n") == 1) & F.col("one.alone")), f"{at}/kinds")
    equal = each.where("alone").join(shared.written(kinds.where("n > 1").select("hash", "context"), f"{at}/equal"), ["hash", "context"])
    found = [equal.select("digest", F.col("first").alias("begin"), (F.col("last") + LENGTH).alias("end"))]
    groups = kinds.groupBy("hash").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.expr(f"one.last - one.first + {LENGTH}")).alias("bytes")).where("kinds > 1")
    groups = shared.written(groups, f"{at}/groups")
    cold = kinds.join(groups.where(F.col("bytes") <= GROUP_BYTES).select("hash"), "hash")
    contexts = _texts_of(rows, cold, f"{at}/wanted").mapInArrow(_cut, "hash long, digest binary, first long, alone boolean, context binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found.append(contexts.repartition(parts, "hash").sortWithinPartitions("hash").mapInArrow(_sorted_contexts, "digest binary, begin long, end long"))
    hot = groups.where(F.col("bytes") > GROUP_BYTES).select("hash")
    if sizes and not hot.isEmpty():
        schema = "digest binary, gram long, hash long, context long, first long, last long, alone boolean"
        finer = shared.written(_texts_of(rows, kinds.join(hot, "hash"), f"{at}/hot").mapInArrow(_slabbed(sizes[0]), schema), f"{at}/slabs")
        found += _resolved(spark, rows, finer, f"{at}/{sizes[0]}", sizes[1:])
    return found


def removed_runs(spark: SparkSession, rows: DataFrame, at: str) -> DataFrame:
    """(digest, begin, end) of rows (digest, text): what is removed, in pieces that may overlap."""
    runs = shared.written(
        _runs(rows).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", "hashes", "contexts", "firsts", "lasts")]), f"{at}/runs"
    )
    found = runs.where(f"copies > 1 AND n >= {LENGTH}").select("digest", F.lit(0).cast("long").alias("begin"), F.col("n").alias("end"))
    often = runs.select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    often = shared.written(often, f"{at}/often")  # so that the join below is of two plain shuffles, whose hot partitions can be split
    each = runs.select("digest", (F.col("copies") == 1).alias("alone"), F.explode(F.arrays_zip("hashes", "contexts", "firsts", "lasts")).alias("r"))
    each = each.select("digest", F.col("r.hashes").alias("hash"), F.col("r.contexts").alias("context"), F.col("r.firsts").alias("first"), F.col("r.lasts").alias("last"), "alone", F.col("r.hashes").alias("gram"))
    each = shared.written(each.join(often, "hash"), f"{at}/repeated")
    for part in _resolved(spark, rows, each, at, SLABS):
        found = found.unionByName(part)
    return found


def dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    at = shared.work_dir(spark, "suffix-dedup")
    text = F.coalesce(text_col, F.lit(""))
    digest = F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))
    removed = removed_runs(spark, docs.select(digest.alias("digest"), text.alias("text")), at)
    spans = shared.written(removed.groupBy("digest").agg(F.collect_list(F.struct("begin", "end")).alias("spans")), f"{at}/spans")  # of one text
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest.alias("digest"), text.alias("text")).join(spans, "digest", "left").select("doc_id", "text", "spans")

    def result(frames):
        import pyarrow as pa

        for frame in frames:
            for first in range(0, frame.num_rows, 500):
                part, table = frame.slice(first, 500), []
                for text, found in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    raw, kept, at = text.encode(), hashlib.sha256(), 0
                    gone = merged([(s["begin"], s["end"]) for s in found or ()])
                    for begin, end in gone:
                        kept.update(raw[at:begin])
                        at = end
                    kept.update(raw[at:])
                    table.append((len(raw), sum(e - b for b, e in gone), len(gone), kept.hexdigest()))
                columns = list(zip(*table, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(result, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
