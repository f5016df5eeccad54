"""Language-model scoring with a probabilistic suffix tree.

Texts are read as their tokens joined by single spaces, with ASCII lower-cased, and one end
symbol; the tree's symbols are bytes. Contexts of up to ``DEPTH`` symbols are counted over
all training rows. A context is retained when its next-symbol distribution diverges from
that of its longest proper suffix: count x KL must reach ``GAIN`` nats, at any input size, so
the tree grows with the training text. Distributions are smoothed by their suffix's (``BETA``
pseudo-counts).

The tree stays in shards by the two symbols next to the predicted one. Each batch of texts
sends a shard its distinct (context, next) codes with the rows they occur in (as steps from one
row to the next), and gets back the rows' sums of log probabilities; only contexts of up to one
symbol go to all workers.

Counts travel as sorted, compressed blocks, by the two symbols next to the predicted one.
The unigram base needs each token's training count: tokens with ``FREQUENT`` of all training
tokens at least are broadcast (at most 1 / FREQUENT of them), all others are joined.

Defined results: a null or empty text is the end token alone; null ids train and are scored,
never held out; repeated rows count and are scored each; without training rows all counts
are 0, the base is 0 and symbols are equally likely; an empty table gives an empty table;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import classify, shared

DEPTH = 6
GAIN = 20.0
BETA = 10.0
FREQUENT = 1e-6
END = 10
_LOWER = bytes(range(256)).lower()
#: Bytes of text counted or scored at once, and distinct words held by a task before it hands them on.
BATCH_BYTES = 6_000_000
HELD_WORDS = 300_000


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def stream(words: list[bytes]) -> bytes:
    return b" ".join(words) + b"\n"


def _batches(frames, column: int):
    """Row groups of about ``BATCH_BYTES`` of text: (frame, first, texts)."""
    for frame in frames:
        sizes = frame.column(column).nbytes // max(frame.num_rows, 1) + 1
        step = max(1, BATCH_BYTES // sizes)
        for at in range(0, frame.num_rows, step):
            yield frame, at, frame.column(column).slice(at, step).to_pylist()


def gram_codes(streams: list[bytes], depth: int = DEPTH, numbers: np.ndarray | None = None, bits: int = 8) -> np.ndarray:
    """The (context, next) code of each place, oldest symbol first. Starts are padded by end symbols.

    ``numbers`` are the symbols' numbers of ``bits`` bits, by byte; without them a symbol is its byte.
    """
    pad = bytes([END]) * depth
    buffer = np.frombuffer(b"".join(pad + s for s in streams), np.uint8)
    codes, size = (buffer if numbers is None else numbers[buffer]).astype(np.uint64), 1
    while size <= depth:  # by doubling: the code from here on, and the last symbols of one further on
        step = min(size, depth + 1 - size)
        longer = codes[:-step] << np.uint64(bits * step)
        longer |= codes[step:] if step == size else codes[step:] & np.uint64((1 << bits * step) - 1)
        codes, size = longer, size + step
    real = np.ones(len(buffer), bool)
    ends = np.cumsum([len(s) + depth for s in streams])
    for k in range(depth):
        real[np.concatenate([[0], ends[:-1]]) + k] = False
    return codes[real[depth:]]


def gram_counts(streams: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (context, next) codes and their counts."""
    return _counted(gram_codes(streams, depth))


def _counted(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        codes = np.sort(codes)
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
        return codes[first], np.diff(np.append(first, len(codes)))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def _packed(codes: np.ndarray, counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([np.diff(codes, prepend=np.uint64(0)), counts.astype(np.uint64)]).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    flat = np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    half = len(flat) // 2
    return np.cumsum(flat[:half], dtype=np.uint64), flat[half:].astype(np.int64)


def _shards(codes: np.ndarray, n: int) -> np.ndarray:
    return ((codes >> np.uint64(8) & np.uint64(0xFFFF)) * np.uint64(40503) >> np.uint64(4)) % np.uint64(n)


def count_contexts(rows: DataFrame, shards: int) -> DataFrame:
    """(shard, blob) with the summed counts of the shard's codes, from column ``text``."""

    def local(frames):
        import pyarrow as pa

        held: list = []

        def merged():
            codes, counts = _counted(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held[:] = [(codes, counts)]
            return codes, counts

        for _, _, texts in _batches(frames, 0):
            held.append(gram_counts([stream(tokens(t)) for t in texts]))
            if len(held) > 4:
                merged()
        if held:
            codes, counts = merged()
            of = _shards(codes, shards)
            for shard in range(shards):
                at = of == shard
                if at.any():
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "blob": [_packed(codes[at], counts[at])]})

    def total(key, group):
        import pandas as pd

        codes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        blobs = list(group["blob"])
        for at in range(0, len(blobs), 16):
            more = [(codes, counts), *map(_unpacked, blobs[at : at + 16])]
            codes, counts = _counted(*(np.concatenate(x) for x in zip(*more, strict=True)))
        return pd.DataFrame({"shard": [key[0]], "blob": [_packed(codes, counts)]})

    return rows.select("text").mapInArrow(local, "shard int, blob binary").groupBy("shard").applyInPandas(total, "shard int, blob binary")


def _node_sums(keys: np.ndarray, counts: np.ndarray):
    """Contexts (key without the next symbol), the row where each begins, and their totals."""
    contexts = keys >> np.uint64(8)
    first = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return contexts[first], first, np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)


def retained(codes: np.ndarray, counts: np.ndarray, order1: tuple[np.ndarray, np.ndarray], symbols: int, depth: int = DEPTH) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, keys, counts) of the contexts of 2 symbols and more that a shard retains, with all their next symbols.

    What is retained doesn't depend on ``symbols``, the size of the training text.
    """
    levels = {1: order1}
    for k in range(depth, 1, -1):
        levels[k] = _counted(codes & np.uint64((1 << 8 * (k + 1)) - 1), counts)
    keep: dict[int, np.ndarray] = {}
    wanted = np.zeros(0, np.uint64)  # suffixes of longer retained contexts
    for k in range(depth, 1, -1):
        keys, n = levels[k]
        contexts, first, totals = _node_sums(keys, n)
        up, up_n = levels[k - 1]
        up_contexts, _, up_totals = _node_sums(up, up_n)
        suffix = keys & np.uint64((1 << 8 * k) - 1)
        p_up = up_n[np.searchsorted(up, suffix)] / up_totals[np.searchsorted(up_contexts, suffix >> np.uint64(8))]
        total = np.repeat(totals, np.diff(np.append(first, len(keys))))
        gains = np.add.reduceat(n * np.log(n / total / p_up), first) if len(first) else np.zeros(0)
        chosen = contexts[(gains >= GAIN) | np.isin(contexts, wanted)]
        keep[k], wanted = chosen, np.unique(chosen & np.uint64((1 << 8 * (k - 1)) - 1))
    found = []
    for k, chosen in keep.items():
        keys, n = levels[k]
        at = np.isin(keys >> np.uint64(8), chosen)
        found.append((k, keys[at], n[at]))
    return found


class Automaton:
    """The longest-suffix states of a whole retained tree: dense, so for small trees; ``likelihoods`` gives the same from shards."""

    def __init__(self, levels: dict[int, tuple[np.ndarray, np.ndarray]], depth: int = DEPTH):
        """levels: for each context length its (context, next) keys and counts."""
        states: dict[int, np.ndarray] = {k: np.unique(levels[k][0] >> np.uint64(8)) if k in levels else np.zeros(0, np.uint64) for k in range(1, depth + 1)}
        for k in range(depth, 1, -1):  # a state's prefix must be a state, to get there
            states[k - 1] = np.union1d(states[k - 1], states[k] >> np.uint64(8))
        states[0] = np.zeros(1, np.uint64)
        base = dict(zip(range(depth + 1), np.cumsum([0, *[len(states[k]) for k in range(depth + 1)]]).tolist(), strict=False))
        seen = np.unique(np.concatenate([levels[0][0] & np.uint64(255), [END]]).astype(np.uint8)) if 0 in levels else np.array([END], np.uint8)
        self.column = np.full(256, len(seen), np.int32)  # the last column is for symbols that training text never has
        self.column[seen] = np.arange(len(seen))
        self.width, n = len(seen) + 1, sum(map(len, states.values()))
        logs = np.zeros((n, self.width))
        to = np.zeros((n, self.width), np.int32)
        unseen = 256 - len(seen)
        for k in range(depth + 1):
            rows = base[k] + np.arange(len(states[k]))
            if k:
                parent = base[k - 1] + np.searchsorted(states[k - 1], states[k] & np.uint64((1 << 8 * (k - 1)) - 1))
                logs[rows], to[rows] = logs[parent], to[parent]
            else:
                logs[0] = 1 / 256
            keys, counts = levels.get(k, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            if len(keys):
                own, first, totals = _node_sums(keys, counts)
                at = base[k] + np.searchsorted(states[k], own)
                share = BETA / (totals + BETA)
                logs[at] *= share[:, None]
                per_key = np.repeat(np.arange(len(own)), np.diff(np.append(first, len(keys))))
                logs[at[per_key], self.column[keys & np.uint64(255)]] += counts / (totals + BETA)[per_key]
        # The last column stood for each unseen symbol alone, so a row's sum counts it `unseen` times.
        self.unseen = unseen
        self.logs = np.log10(logs).astype(np.float32)
        for k in range(1, depth + 1):
            rows = base[k] + np.arange(len(states[k]))
            parent = base[k - 1] + np.searchsorted(states[k - 1], states[k] & np.uint64((1 << 8 * (k - 1)) - 1))
            to[rows] = to[parent]
            if k == 1:
                to[0, self.column[states[1].astype(np.int64)]] = rows
                to[rows] = to[0]
            if k < depth and len(states[k + 1]):
                prefix = base[k] + np.searchsorted(states[k], states[k + 1] >> np.uint64(8))
                to[prefix, self.column[(states[k + 1] & np.uint64(255)).astype(np.int64)]] = base[k + 1] + np.arange(len(states[k + 1]))
        state = 0
        for _ in range(depth):
            state = to[state, self.column[END]]
        to[:, self.column[END]] = state
        self.start, self.depth = int(state), depth
        self.to, self.logs = to.ravel(), self.logs.ravel()

    def scores(self, streams: list[bytes]) -> np.ndarray:
        """log10 probabilities of whole streams. Lanes of the joined text advance together."""
        if not streams:
            return np.zeros(0)
        text = self.column[np.frombuffer(b"".join(streams), np.uint8)]
        n, d = len(text), self.depth
        steps = max(64, math.isqrt(n))
        lanes = -(-n // steps)
        padded = np.full(d + lanes * steps, self.column[END], np.int32)
        padded[d : d + n] = text
        grid = np.ascontiguousarray(padded[np.arange(lanes)[:, None] * steps + np.arange(steps + d)].T)
        state = np.full(lanes, self.start, np.int64)
        found = np.empty((steps, lanes), np.float32)
        for k in range(steps + d):
            at = state * self.width + grid[k]
            if k >= d:
                np.take(self.logs, at, out=found[k - d])
            state = self.to[at].astype(np.int64)
        each = found.T.ravel()[:n]
        ends = np.cumsum([len(s) for s in streams])
        return np.add.reduceat(each.astype(np.float64), np.concatenate([[0], ends[:-1]]))


def _tables(levels: dict[int, tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, ...]]:
    """Contexts, their totals, keys and counts of each context length, up to the first that has none."""
    found = []
    for k in range(DEPTH + 1):
        if k not in levels or not len(levels[k][0]):
            break
        contexts, _, totals = _node_sums(*levels[k])
        found.append((contexts, totals, *levels[k]))
    return found


def likelihoods(codes: np.ndarray, tables: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """log10 probabilities of (context, next) codes. ``tables`` hold the retained suffixes of all their contexts."""
    p, live = np.full(len(codes), 1 / 256), np.arange(len(codes))
    for k, (contexts, totals, keys, counts) in enumerate(tables):
        own = codes[live] & np.uint64((1 << 8 * (k + 1)) - 1)
        at = np.minimum(np.searchsorted(contexts, own >> np.uint64(8)), len(contexts) - 1)
        held = contexts[at] == own >> np.uint64(8)
        live, own, total = live[held], own[held], totals[at[held]]
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        p[live] = (p[live] * BETA + np.where(keys[at] == own, counts[at], 0)) / (total + BETA)
    return np.log10(p)


def _places(streams: list[bytes], shards: int):
    """(shard, packed distinct codes and counts, packed rows) of a batch's places; ``rows`` are the streams' numbers.

    Symbols are numbered in the order of their bytes, so that a code and its row fit into one number and a
    plain sort brings equal codes together. Where they don't, each half of the batch has blocks of its own.
    """
    seen = np.flatnonzero(np.bincount(np.frombuffer(b"".join([*streams, bytes([END])]), np.uint8), minlength=256))
    numbers = np.zeros(256, np.uint8)
    numbers[seen] = np.arange(len(seen))
    bits = max(1, int(len(seen) - 1).bit_length())
    pairs = np.arange(len(seen))[:, None] << bits | np.arange(len(seen))
    of_pair = np.zeros(1 << 2 * bits, np.uint16 if shards <= 1 << 16 else np.uint32)  # of two bytes, places are dealt by counting
    of_pair[pairs] = _shards((seen[:, None] << 8 | seen).astype(np.uint64) << np.uint64(8), shards)
    most, at = 1 << 64 - bits * (DEPTH + 1), 0
    step = len(streams) if len(streams) <= most else min(most, -(-len(streams) // 2))
    while at < len(streams):
        own, first_row, at = streams[at : at + step], at, at + step
        row_bits = np.uint64(max(1, (len(own) - 1).bit_length()))
        keys = gram_codes(own, DEPTH, numbers, bits)
        of = of_pair[(keys >> np.uint64(bits) & np.uint64((1 << 2 * bits) - 1)).astype(np.int64)]
        keys = keys << row_bits | np.repeat(np.arange(len(own), dtype=np.uint64), [len(s) for s in own])
        keys = keys[np.argsort(of, kind="stable")]
        ends = np.cumsum(np.bincount(of, minlength=shards))
        for shard, (first, last) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
            if first < last:
                found = np.sort(keys[first:last])
                rows, found = (found & (np.uint64(1) << row_bits) - np.uint64(1)).astype(np.int64) + first_row, found >> row_bits
                starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
                found, codes = found[starts], np.zeros(len(starts), np.uint64)
                for k in range(DEPTH, -1, -1):
                    codes = codes << np.uint64(8) | seen[(found >> np.uint64(bits * k) & np.uint64((1 << bits) - 1)).astype(np.int64)].astype(np.uint64)
                yield shard, _packed(codes, np.diff(np.append(starts, last - first))), _packed_rows(rows, starts, len(streams))


def _row_type(n_rows: int) -> np.dtype:
    return np.dtype(np.uint16 if n_rows <= 1 << 16 else np.uint32)


def _packed_rows(rows: np.ndarray, starts: np.ndarray, n_rows: int) -> bytes:
    """Rows that ascend from each start to the next, as byte planes of their steps: those of a frequent code are small."""
    steps, kind = np.diff(rows, prepend=0), _row_type(n_rows)
    steps[starts] = rows[starts]
    return zstandard.ZstdCompressor(level=1).compress(steps.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes())


def _unpacked_rows(blob: bytes, counts: np.ndarray, n_rows: int) -> np.ndarray:
    kind = _row_type(n_rows)
    steps = np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()
    rows, starts = np.cumsum(steps, dtype=np.int64), np.cumsum(counts) - counts
    return rows - np.repeat(rows[starts] - steps[starts], counts)


def _sums(blob: bytes, rows: bytes, n_rows: int, tables: list[tuple[np.ndarray, ...]]) -> bytes:
    """A shard's part of the scores of a batch's rows."""
    codes, counts = _unpacked(blob)
    return np.bincount(_unpacked_rows(rows, counts, n_rows), np.repeat(likelihoods(codes, tables), counts), n_rows).tobytes()


def _packed_table(batch) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def fit_tree(rows: DataFrame, at: str, shards: int) -> tuple[dict[int, bytes], DataFrame]:
    """The retained tree of column ``text``: packed (context, next) keys and counts of lengths 0 and 1, and (shard, k, blob) of longer ones."""
    counted = shared.written(count_contexts(rows, shards), f"{at}/contexts")

    def pairs(frames):
        import pyarrow as pa

        for frame in frames:
            for blob in frame.column("blob").to_pylist():
                codes, counts = _unpacked(blob)
                keys, n = _counted(codes & np.uint64(0xFFFF), counts)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], ["key", "n"])

    order1 = counted.mapInArrow(pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()  # at most 256 x 256 rows
    table = np.array(sorted((r["key"], r["n"]) for r in order1), np.int64).reshape(-1, 2)
    one = table[:, 0].astype(np.uint64), table[:, 1]
    symbols = int(table[:, 1].sum())

    def keep(frames):
        import pyarrow as pa

        for frame in frames:
            for shard, blob in zip(*[frame.column(c).to_pylist() for c in ("shard", "blob")], strict=True):
                for k, keys, n in retained(*_unpacked(blob), one, symbols):
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "k": pa.array([k], pa.int32()), "blob": [_packed(keys, n)]})

    short = {0: _packed(*_counted(one[0] & np.uint64(255), one[1])), 1: _packed(*one)} if symbols else {}
    return short, shared.written(counted.repartition(shards, "shard").mapInArrow(keep, "shard int, k int, blob binary"), f"{at}/tree")


def token_counts(rows: DataFrame) -> DataFrame:
    """(token, n) over column ``text``; the end token is a line feed."""

    def local(frames):
        import pyarrow as pa

        held: Counter = Counter()

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["token", "n"])
            held.clear()
            return batch

        for frame in frames:
            for text in frame.column(0):
                held.update(tokens(text.as_py()))
                held[b"\n"] += 1
                if len(held) > HELD_WORDS:
                    yield flush()
        if held:
            yield flush()

    return rows.select("text").mapInArrow(local, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def score(spark: SparkSession, docs: DataFrame, parts: int = 7, part: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    at = shared.work_dir(spark, "suffix-tree")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), classify.held_out("doc_id", parts, part).alias("held_out"), "text")
    training = rows.where(~F.col("held_out"))
    shards = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    short, tree = fit_tree(training, at, shards)
    counts = shared.written(token_counts(training), f"{at}/tokens")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    common = counts.where(F.col("n") >= max(1.0, FREQUENT * n)) if n else counts.limit(0)  # at most 1 / FREQUENT rows
    known = spark.sparkContext.broadcast({bytes(r["token"]): math.log10(r["n"] + 1) for r in common.toLocalIterator()})
    base_levels = spark.sparkContext.broadcast(short)  # at most 256 x 256 counts

    def split(frames):
        import pyarrow as pa
        from pyspark import TaskContext

        get = known.value.get
        row = TaskContext.get().partitionId() << 40
        for frame, first, texts in _batches(frames, 2):
            streams, table, batch = [], [], row
            for text in texts:
                own = tokens(text)
                streams.append(stream(own))
                own.append(b"\n")
                logs = list(map(get, own))
                rare = Counter([w for w, x in zip(own, logs, strict=True) if x is None]) if None in logs else {}
                table.append((row, len(own), len(own) - sum(rare.values()), math.fsum(filter(None, logs)), list(rare), list(rare.values())))
                row += 1
            own = [*[frame.column(i).slice(first, len(texts)) for i in (0, 1)], *[pa.array(c, t) for c, t in zip(zip(*table, strict=True), kinds, strict=True)]]
            yield message(batch // 7 % shards, 2, batch, len(texts), _packed_table(pa.RecordBatch.from_arrays(own, names)), None)
            for shard, blob, rows_of in _places(streams, shards):
                yield message(shard, 1, batch, len(texts), blob, rows_of)

    def message(*values):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "kind", "batch", "n", "blob", "rows_of"])

    def summed(frames):  # a shard's tree (kind 0, n: context length) comes before what is asked of it (kind 1); kind 2 passes
        import pyarrow as pa

        now, levels, tables = None, {}, None
        for frame in frames:
            out = []
            for shard, kind, batch, n, blob, rows_of in zip(*[frame.column(c).to_pylist() for c in ("shard", "kind", "batch", "n", "blob", "rows_of")], strict=True):
                if shard != now:
                    now, levels, tables = shard, {k: _unpacked(b) for k, b in base_levels.value.items()}, None
                if kind == 0:
                    levels[n] = _unpacked(blob)
                    continue
                if kind == 1:
                    tables = _tables(levels) if tables is None else tables
                    blob = _sums(blob, rows_of, n, tables)
                out.append((kind, batch, blob))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["kind", "batch", "blob"])

    def total(table):
        import pyarrow as pa

        kinds, blobs = (table.column(c).to_pylist() for c in ("kind", "blob"))
        sums = [np.frombuffer(b, np.float64) for k, b in zip(kinds, blobs, strict=True) if k == 1]
        return pa.ipc.open_stream(blobs[kinds.index(2)]).read_all().append_column("score", pa.array(np.sum(sums, axis=0)))

    kinds = (pyarrow.int64(), pyarrow.int64(), pyarrow.int64(), pyarrow.float64(), pyarrow.list_(pyarrow.binary()), pyarrow.list_(pyarrow.int64()))
    out = "doc_id long, held_out boolean, row long, n_tokens long, n_common long, logs double, rare array<binary>, times array<long>"
    names = ["doc_id", "held_out", "row", "n_tokens", "n_common", "logs", "rare", "times"]
    trees = tree.select("shard", F.lit(0).alias("kind"), F.col("k").cast("long").alias("n"), "blob")
    asked = rows.mapInArrow(split, "shard int, kind int, batch long, n long, blob binary, rows_of binary").unionByName(trees, allowMissingColumns=True)
    parts = asked.repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(summed, "kind int, batch long, blob binary")
    table = shared.written(parts.groupBy("batch").applyInArrow(total, f"{out}, score double"), f"{at}/scored")
    rare = table.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("token"), F.col("r.times").alias("times"))
    rest = rare.join(counts, "token").groupBy("row").agg(F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_logs"))
    base = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(n + v + 1))
    return table.drop("rare", "times").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_common") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
