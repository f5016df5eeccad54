"""Near-duplicate detection by Order MinHash.

A text's k-mers are its shingles of five words, each labelled with its occurrence number.
For every hash function the ``LENGTH`` least labelled k-mers are sampled and kept in their
text order; ``ROWS`` such samples make a band's key. Texts that share a band key are
candidates, all of them. Buckets of up to ``ALL_PAIRS`` texts make pairs. In a larger one every
text is first held against ``PIVOTS`` texts of the bucket; what is still in different classes
then is compared in full: buckets of up to ``BLOCK`` texts in a task each, and larger ones in
tasks of two blocks of texts. So no link that joins two
classes is lost, and only pairs whose ends are in one class already go uncompared. A candidate is verified by banded alignment of the two shingle sequences: with
M aligned shingles of n and m, the similarity M / (n + m - M) must be 0.8 or more. Linked
texts form classes (connected components); exact copies share a class from the start.

With BANDS bands, a pair of similarity 0.8 shares no key with a probability of
(1 - 0.8 ** (LENGTH * ROWS)) ** BANDS, under 0.001, and a more similar pair far less.

Defined results: a text of fewer than five words is one shingle; null and empty texts are
equal to each other and to nothing else; of a class the least id stays (null ids only where
there is no other); rows that repeat id and text share their verdict, and ``drop_near``
keeps one of them; an empty table gives an empty table; other columns are ignored by
``classes`` and kept by ``drop_near``, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import shared
from brindle.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
LENGTH = 2
ROWS = 3
BANDS = 24
#: Buckets up to this size make pairs; the texts of larger ones are held against so many of them first.
ALL_PAIRS = 16
PIVOTS = 4
#: A bucket of at most so many texts and shingles is compared in one task, and a larger one in blocks of about so many.
BLOCK = 1000
BLOCK_SHINGLES = 1_000_000
BATCH_BYTES = 1_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SEEDS = np.random.default_rng(20).integers(1, 1 << 63, (ROWS * BANDS, 2), np.uint64) * np.uint64(2) + np.uint64(1)
_TOP = np.uint64((1 << 64) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse; those of a single long text aren't kept."""

    def make(size: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        return np.cumprod(up, out=up), np.cumprod(down, out=down)

    return make(n) if n > 2 * BATCH_BYTES else shared.remembered(("powers", 2 * BATCH_BYTES), lambda: make(2 * BATCH_BYTES))


def shingles(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles in order, and how many each text has."""
    flat = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    up, down = _power(len(flat))
    word = ~_SPACE[flat]
    edges = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    sums = np.zeros(len(flat) + 1, np.uint64)
    own = sums[1:]  # in place: a long text's arrays are eight times its size
    own += flat
    own += np.uint64(1)
    own *= up[: len(flat)]
    np.cumsum(own, out=own)
    words = _mix((sums[ends] - sums[begins]) * down[begins]) if len(begins) else np.zeros(0, np.uint64)
    limits = np.cumsum([len(r) + 1 for r in raws])
    n_words = np.diff(np.concatenate([[0], np.searchsorted(begins, limits)]))
    counts = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, (n_words > 0).astype(np.int64))
    offsets = np.cumsum(n_words) - n_words
    first = np.repeat(offsets, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    size = np.repeat(np.minimum(n_words, SHINGLE), counts)
    found = np.zeros(len(first), np.uint64)
    padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    for k in range(SHINGLE):
        found = np.where(k < size, (found + padded[first + k]) * np.uint64(0xD6E8FEB86659FD93), found)
    return _mix(found), counts


def labelled(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each shingle's hash together with its occurrence number in its text."""
    of = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, of))
    h, o = hashes[order], of[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])]) if len(h) else np.zeros(0, bool)
    at = np.arange(len(h))
    times = np.empty(len(h), np.uint64)
    times[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return np.where(times > 0, _mix(hashes + times * _BASE), hashes)


def band_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` keys for each text; all texts must have shingles."""
    starts, keys = np.cumsum(counts) - counts, np.zeros((len(counts), BANDS), np.uint64)
    of = np.repeat(np.arange(len(counts)), counts)
    for j in range(ROWS * BANDS):
        values = (hashes ^ _SEEDS[j, 0]) * _SEEDS[j, 1]
        values ^= values >> np.uint64(32)
        values *= _SEEDS[j, 0]
        sample = []
        for _ in range(LENGTH):
            least = np.minimum.reduceat(values, starts)
            at = np.flatnonzero(values == least[of])
            where = np.zeros(len(counts), np.int64)
            where[of[at][::-1]] = at[::-1]
            sample.append((where, hashes[where]))
            values[at] = _TOP
        order = np.argsort(np.stack([w for w, _ in sample]), axis=0, kind="stable")
        kmers = np.take_along_axis(np.stack([k for _, k in sample]), order, axis=0)
        band = j // ROWS
        for k in kmers:
            keys[:, band] = (keys[:, band] + k) * np.uint64(0xD6E8FEB86659FD93)
            keys[:, band] ^= keys[:, band] >> np.uint64(29)
    return _mix(keys + np.arange(BANDS, dtype=np.uint64))


def sketches(rows: DataFrame) -> DataFrame:
    """(doc_id, digest, n, keys) of rows (doc_id, digest, text): shingle count and band keys (empty without words)."""

    def run(frames):
        import pyarrow as pa
        import pyarrow.compute as pc

        for frame in frames:
            ends, at = np.cumsum(pc.binary_length(frame.column(2)).to_numpy(zero_copy_only=False), dtype=np.int64), 0
            while at < frame.num_rows:  # BATCH_BYTES at most, or one longer text
                step = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES, side="right")) - at)
                part, at = frame.slice(at, step), at + step
                hashes, counts = shingles([t.encode() for t in part.column(2).to_pylist()])
                some = np.flatnonzero(counts)
                keys = band_keys(labelled(hashes, counts), counts[some]) if len(some) else np.zeros((0, BANDS), np.uint64)
                offsets = np.concatenate([[0], np.cumsum(np.where(counts > 0, BANDS, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64()), lists], ["doc_id", "digest", "n", "keys"])

    return rows.mapInArrow(run, "doc_id long, digest binary, n long, keys array<long>")


def aligned(a: list[int], b: list[int], most: int) -> int | None:
    """Pairs in the best in-order alignment of a and b, if it leaves at most ``most`` items out, else None.

    Diagonals further than ``most`` from the main one can't be reached: the band.
    """
    n, m = len(a), len(b)
    reach = {1: 0}
    for d in range(most + 1):
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            reach[k] = x
            if x >= n and y >= m:
                return (n + m - d) // 2
    return None


def similar(a: np.ndarray, a_labelled: np.ndarray, b: np.ndarray, b_labelled: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the alignment of two shingle sequences gives M / (n + m - M) >= least."""
    n, m = len(a), len(b)
    need = -(-round(1000 * least) * (n + m) // (1000 + round(1000 * least)))
    if min(n, m) < need or not need:
        return False
    common, in_a, in_b = np.intersect1d(a_labelled, b_labelled, assume_unique=True, return_indices=True)
    if len(common) < need:  # no alignment has more
        return False
    places = in_b[np.argsort(in_a)]
    if (np.diff(places) > 0).all():
        return True
    rising: list[int] = []  # an alignment that joins equal occurrence numbers
    for place in places.tolist():
        at = bisect_left(rising, place)
        rising[at : at + 1] = [place]
    if len(rising) >= need:
        return True
    left_a, left_b = a[np.isin(a, b)], b[np.isin(b, a)]
    got = aligned(left_a.tolist(), left_b.tolist(), len(left_a) + len(left_b) - 2 * need)
    return got is not None and got >= need


def _verified(pairs: DataFrame, texts: DataFrame, first_only: bool) -> DataFrame:
    """(u, v) of the pairs (u, v, turn) that are similar; with ``first_only``, of each v's pairs the first by turn that is.

    Rows of one v come together, so it is read once.
    """
    with_u = pairs.join(texts.select(F.col("digest").alias("u"), F.col("text").alias("u_text")), "u")
    both = with_u.join(texts.select(F.col("digest").alias("v"), F.col("text").alias("v_text")).hint("merge"), "v").sortWithinPartitions("v", "turn")

    def run(frames):
        import pyarrow as pa

        last, parsed, done = None, None, False

        def parse(text):
            hashes, counts = shingles([text.encode()])
            return hashes, labelled(hashes, counts)

        for frame in frames:
            keep = []
            for v, u_text, v_text in zip(*[frame.column(c).to_pylist() for c in ("v", "u_text", "v_text")], strict=True):
                if v != last:
                    last, parsed, done = v, parse(v_text), False
                keep.append(not (done and first_only) and similar(*parse(u_text), *parsed))
                done |= keep[-1]
            yield frame.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.select("u", "v", "u_text", "v_text").mapInArrow(run, "u binary, v binary")


def _joins(table, left: np.ndarray, right: np.ndarray, comparable):
    """(u, v) links that join classes, of texts of one task; ``comparable(u)`` tells which texts are to be compared with u here.

    A class is what is known to be linked before, or is found here: pairs within one aren't compared.
    """
    import pyarrow as pa

    texts, digests = table.column("text"), table.column("digest").to_pylist()
    known: dict[bytes, int] = {}
    family = np.array([known.setdefault(r, len(known)) for r in table.column("root").to_pylist()], np.int64)
    root = list(range(len(known)))
    ends, at, parts = np.cumsum([len(t.as_py().encode()) for t in texts], dtype=np.int64), 0, []
    while at < len(ends):
        step = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES, side="right")) - at)
        hashes, sizes = shingles([t.encode() for t in texts.slice(at, step).to_pylist()])
        parts.append((hashes, labelled(hashes, sizes), sizes))
        at += step
    hashes, marks, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    stops = np.cumsum(n)
    starts = stops - n
    of = np.repeat(np.arange(len(n)), n)
    inside = np.flatnonzero(np.isin(of, right))
    inside = inside[np.argsort(marks[inside], kind="stable")]
    listed, owner, place = marks[inside], of[inside], (np.arange(len(of)) - starts[of])[inside]

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    joins = []
    for u in left.tolist():
        need = -(-round(1000 * SIMILARITY) * (n + n[u]) // (1000 + round(1000 * SIMILARITY)))
        may = comparable(u) & (np.minimum(n, n[u]) >= need) & (family != family[u])
        if not may.any():
            continue
        own = marks[starts[u] : stops[u]]
        low, high = np.searchsorted(listed, own), np.searchsorted(listed, own, side="right")
        each = high - low
        found = np.repeat(low - (np.cumsum(each) - each), each) + np.arange(each.sum())
        found = found[may[owner[found]]]
        may &= np.bincount(owner[found], minlength=len(n)) >= need
        found = found[may[owner[found]]]
        found = found[np.argsort(owner[found], kind="stable")]
        o, p = owner[found], place[found]
        crossed = np.zeros(len(n), bool)
        crossed[o[1:][(o[1:] == o[:-1]) & (p[1:] < p[:-1])]] = True
        for v in np.flatnonzero(may).tolist():
            a, b = top(int(family[u])), top(int(family[v]))
            if a == b or crossed[v] and not similar(hashes[starts[u] : stops[u]], own, hashes[starts[v] : stops[v]], marks[starts[v] : stops[v]]):
                continue
            root[a] = b
            joins.append((digests[u], digests[v]))
    columns = list(zip(*joins, strict=True)) or [[]] * 2
    return pa.table({name: pa.array(c, pa.binary()) for name, c in zip("uv", columns, strict=True)})


def _bits(table, name: str) -> np.ndarray:
    return (table.column(name).to_numpy()[:, None] >> np.arange(BANDS)) & 1 > 0


def _keys(table) -> np.ndarray:
    return np.array(table.column("keys").to_pylist(), np.int64).reshape(-1, BANDS)


def _bucket(table):
    """Links within one middle bucket. A pair is compared in the first middle bucket that it shares, if it shares no small one."""
    keys, middle, large, everything = _keys(table), _bits(table, "middle"), _bits(table, "large"), np.arange(table.num_rows)
    band = table.column("band")[0].as_py()

    def comparable(u: int) -> np.ndarray:
        equal = keys == keys[u]
        first = (equal & middle[u]).argmax(1) == band
        return first & ~(equal & ~middle[u] & ~large[u]).any(1) & (everything > u)

    return _joins(table, everything, everything, comparable)


def _block(table, same: bool):
    """Links between two blocks (or within one): of pairs that share a large bucket, and no middle or small one."""
    keys, large = _keys(table), _bits(table, "large")
    second = table.column("second").to_numpy(zero_copy_only=False)
    left, right = np.flatnonzero(~second), np.flatnonzero(~second if same else second)

    def comparable(u: int) -> np.ndarray:
        equal = keys == keys[u]
        wanted = np.zeros(len(keys), bool)
        wanted[right[right > u] if same else right] = True
        return wanted & (equal & large[u]).any(1) & ~(equal & ~large[u]).any(1)

    return _joins(table, left, right, comparable)


def _in_blocks(rest: DataFrame, whole: DataFrame, at: str) -> DataFrame:
    """(u, v) links over all pairs of texts that share a large bucket, no other one and no class.

    rest: (digest, key, size, minor) of the large buckets with more than one class; minor is what
    isn't of its bucket's largest class. Each text is dealt into a block of its largest bucket,
    minor ones apart; two blocks meet, in a task of their own, where a bucket has members in both
    and one of them is minor. So each pair is compared once at any number of bands.
    """
    homes = rest.groupBy("digest").agg(F.max(F.struct("size", "key")).alias("home"), F.max("minor").alias("minor")).select("digest", "minor", F.col("home.key").alias("home"))
    homes = shared.written(homes.join(whole.select("digest", "n"), "digest"), f"{at}/homes")
    parts = homes.groupBy("home", "minor").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    placed = homes.select("digest", "home", "minor").join(shared.written(parts, f"{at}/parts"), ["home", "minor"])
    placed = shared.written(placed.select("digest", "minor", F.xxhash64("home", "minor", F.pmod(F.xxhash64("digest"), F.col("parts"))).alias("block")), f"{at}/placed")
    spread = shared.written(rest.select("digest", "key").join(placed, "digest").select("key", "block", "minor").distinct(), f"{at}/spread")
    side = lambda name: spread.select("key", F.col("block").alias(name), F.col("minor").alias(f"{name}_minor"))
    tasks = side("p").where("p_minor").join(side("q"), "key").where("p <= q OR NOT q_minor").select("p", "q").distinct()
    sides = tasks.select("p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("block"))
    dealt = sides.join(placed.select("digest", "block"), "block").join(whole.select("digest", "large", "root", "keys", "text"), "digest")
    dealt = dealt.select("p", "q", (F.col("block") != F.col("p")).alias("second"), "digest", "large", "root", "keys", "text")
    return dealt.groupBy("p", "q").applyInArrow(lambda key, table: _block(table, key[0].as_py() == key[1].as_py()), "u binary, v binary")


def linked(docs: DataFrame, nodes: DataFrame, at: str) -> DataFrame:
    """(u, v): each linked text but the least of its class, and that least one, as digests.

    docs: (digest, text); nodes: (digest, n, keys), one row per text.
    """
    bands = nodes.select("digest", "n", F.posexplode("keys").alias("band", "key"))
    sizes = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size"), ((F.count(F.lit(1)) <= BLOCK) & (F.sum("n") <= BLOCK_SHINGLES)).alias("middle")).where("size > 1")
    sizes = shared.written(sizes, f"{at}/sizes")
    met = shared.written(bands.join(sizes, "key"), f"{at}/met")
    large = met.where(F.col("size") > ALL_PAIRS)
    alike = lambda u, v: F.least(u, v) >= SIMILARITY * F.greatest(u, v)
    groups = met.where(F.col("size") <= ALL_PAIRS).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("digest", "n"))).alias("g"))  # at most ALL_PAIRS each
    each = groups.select("g", F.posexplode("g").alias("i", "v")).select("v", F.explode(F.slice("g", F.col("i") + 2, ALL_PAIRS)).alias("u"))
    few = each.where(alike(F.col("u.n"), F.col("v.n"))).select(F.col("u.digest").alias("u"), F.col("v.digest").alias("v"), F.lit(0).alias("turn")).distinct()
    pivots = [F.min(F.struct(F.xxhash64("digest", F.lit(i)).alias("by"), F.col("digest").alias("u"), "n", F.lit(i).alias("turn"))) for i in range(PIVOTS)]
    pivots = shared.written(large.groupBy("key").agg(F.array(*pivots).alias("pivots")), f"{at}/pivots")
    stars = large.select("digest", "n", "key").join(pivots, "key").select(F.col("digest").alias("v"), "n", F.explode("pivots").alias("p"))
    stars = stars.where((F.col("p.u") != F.col("v")) & alike(F.col("p.n"), F.col("n"))).groupBy(F.col("p.u").alias("u"), "v").agg(F.min("p.turn").alias("turn"))
    few, stars = shared.written(few, f"{at}/few"), shared.written(stars, f"{at}/stars")
    wanted = few.select("u").unionByName(few.select(F.col("v").alias("u"))).unionByName(large.select(F.col("digest").alias("u"))).select(F.col("u").alias("digest")).distinct()
    texts = docs.join(shared.broadcast_within(shared.written(wanted, f"{at}/wanted"), 100), "digest", "left_semi")
    texts = shared.written(texts.groupBy("digest").agg(F.first("text").alias("text")), f"{at}/texts")
    found = shared.written(_verified(few, texts, False).unionByName(_verified(stars, texts, True)), f"{at}/found")
    roots = components(found, f"{at}/first")
    classes = shared.written(large.join(roots.select(F.col("u").alias("digest"), F.col("v").alias("root")), "digest", "left").withColumn("root", F.coalesce("root", "digest")), f"{at}/classes")
    counted = classes.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size")).groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("size", "root")).alias("most")).where("roots > 1")
    open_ = shared.written(counted.select("key", F.col("most.root").alias("most")), f"{at}/open")
    if open_.isEmpty():
        return roots
    rest = shared.written(classes.join(open_, "key").select("digest", "band", "key", "size", "middle", "root", (F.col("root") != F.col("most")).alias("minor")), f"{at}/rest")
    bits = lambda wanted: F.coalesce(F.bit_or(F.when(wanted, F.expr("shiftleft(1, band)"))), F.lit(0))
    masks = classes.groupBy("digest").agg(bits(F.col("middle")).alias("middle"), bits(~F.col("middle")).alias("large"), F.first("root").alias("root"))
    whole = masks.join(rest.select("digest").distinct(), "digest").join(nodes.select("digest", "n", "keys"), "digest").join(texts, "digest")
    whole = shared.written(whole, f"{at}/members")
    dealt = rest.where("middle").select("key", "band", "digest").join(whole, "digest").select("key", "band", "digest", "middle", "large", "root", "keys", "text")
    more = dealt.groupBy("key").applyInArrow(_bucket, "u binary, v binary")
    beyond = rest.where("NOT middle").select("digest", "key", "size", "minor")
    if not beyond.isEmpty():
        more = more.unionByName(_in_blocks(beyond, whole, at))
    more = shared.written(more, f"{at}/more")
    return roots if more.isEmpty() else components(roots.unionByName(more), f"{at}/second")


def classes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id, class_size, kept, digest."""
    at = shared.work_dir(spark, "near-dedup")
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))
    marked = shared.written(sketches(rows), f"{at}/sketches")
    nodes = marked.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = shared.written(nodes, f"{at}/nodes")
    roots = linked(rows.select("digest", "text"), nodes.where("n > 0").select("digest", "n", "keys"), at).select(F.col("u").alias("digest"), F.col("v").alias("root"))
    members = nodes.join(roots, "digest", "left").select("digest", F.coalesce("root", "digest").alias("root"), "first_id", "copies")
    members = shared.written(members, f"{at}/told")
    whole = members.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "digest")).alias("best"), F.sum("copies").alias("class_size"))
    told = members.join(shared.written(whole, f"{at}/whole"), "root").select("digest", "class_size", F.col("best.first_id").alias("class_id"), (F.col("digest") == F.col("best.digest")).alias("holds"))
    return marked.select("doc_id", "digest").join(told, "digest").select("doc_id", "class_id", "class_size", (F.col("holds") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"), "digest")


def drop_near(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all its columns."""
    kept = classes(spark, docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("digest").alias("_kept_digest")).distinct()
    digest = F.unhex(F.sha2(F.coalesce(docs[text_col], F.lit("")).cast("binary"), 256))
    return docs.join(kept, (digest == kept["_kept_digest"]) & docs[id_col].eqNullSafe(kept["_kept_id"]), "left_semi").dropDuplicates([id_col, text_col])


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "class_size", "kept")
