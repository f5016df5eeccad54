"""Small fixtures against brute force; odd rows and clashing columns for all operators are in test_edges.py."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from brindle.llm import components, decontamination, exact_dedup, near_dedup, packing, quality, secrets, suffix_dedup, suffix_tree_lm, token_output, tokens, toxicity

SCHEMA = "doc_id long, text string, digest string, keep_id long, c0 int, mask int"


def docs(spark, texts):
    return spark.createDataFrame([(None if i == 3 else i, t, "x", None, None, 1) for i, t in enumerate(texts)], SCHEMA)


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


LONG = words(4000, 1)
TEXTS = ["same", "same", "", None, None, LONG, LONG, "é" * 300, "one two", "It's\n\nodd  text\t<|endoftext|> x"]


def test_exact_dedup(spark):
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.dedup(spark, docs(spark, TEXTS)).collect()}
    assert len(got) == len(TEXTS)
    of = lambda i, t: got[i, hashlib.sha256(t.encode()).hexdigest()]
    assert (of(0, "same").keep_id, of(0, "same").kept, of(1, "same").kept, of(1, "same").group_size) == (1, False, True, 2)
    assert (of(4, "").keep_id, of(4, "").group_size, of(None, "").kept) == (4, 3, False)
    kept = exact_dedup.drop_copies(spark, docs(spark, TEXTS).union(docs(spark, TEXTS)))
    assert kept.columns == docs(spark, TEXTS).columns and kept.count() == len({t or "" for t in TEXTS})
    assert exact_dedup.dedup(spark, docs(spark, [])).count() == 0


def test_secret_links(spark):
    weak = "login: alice, see http://db.example:99 and pass: abcd"
    far = "login: alice" + " z" * 300 + " pass: abcd"
    rows = secrets.scan(docs(spark, [weak, far, "login: alice", None, 'é token = "abcdefgh12" TOKEN=short'])).collect()
    spans = {r.doc_id: r.spans for r in rows}
    assert spans[0] == "login:0:12,endpoint:18:38,phrase:43:53"
    assert spans[1] == "" and spans[2] == "" and spans[None] == ""
    assert spans[4] == "assign:2:21" and [r.n_assign for r in rows if r.doc_id == 4] == [1]


def test_decontamination(spark):
    item = words(20, 7)
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "tiny one"), (5, "")], "item_id long, text string")
    text = "AB, " + item.upper().replace(" ", " -- ") + " tail " + words(30, 8)
    rows = {r.doc_id: r for r in decontamination.mark(spark, docs(spark, [text, "a tiny one", "", None, words(50, 9)]), bench).collect()}
    assert (rows[0].n_words, rows[0].n_hit, rows[0].n_items, rows[0].contaminated) == (52, 20, 2, True)
    a, b = map(int, rows[0].spans.split(":"))
    assert text[a:b] == item.upper().replace(" ", " -- ")
    assert (rows[1].n_hit, rows[1].items_sha256) == (2, hashlib.sha256(b"4").hexdigest())
    assert (rows[2].n_words, rows[None].contaminated, rows[4].n_hit) == (0, False, 0)
    kept = decontamination.drop_contaminated(spark, docs(spark, [text, "clean", None]), bench)
    assert kept.columns == docs(spark, []).columns and kept.count() == 2
    assert decontamination.mark(spark, docs(spark, ["x y"]), bench.limit(0)).first().n_words == 2


def test_decontamination_by_items_without_id(spark):
    import duckdb

    a, b, c = (words(20, s) for s in (41, 42, 43))
    bench, table = [(None, a), (None, b), (7, c)], [(0, f"{a} {b}"), (1, f"{a} x {c}"), (2, c), (3, "clean"), (4, None)]
    rows = decontamination.mark(spark, spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).drop("spans").collect()
    con = duckdb.connect()
    for name, key, values in (("documents", "doc_id", table), ("benchmark", "item_id", bench)):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", values)
    assert sorted(map(tuple, rows)) == sorted(con.execute(decontamination.OP8_SQL).fetchall())
    assert {r.doc_id: (r.n_hit, r.n_items) for r in rows} == {0: (40, 1), 1: (40, 2), 2: (20, 1), 3: (0, 0), 4: (0, 0)}
    kept = decontamination.drop_contaminated(spark, spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4]


def test_decontamination_in_blocks(spark, monkeypatch):
    items = [words(20 + i, i) for i in range(12)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate([*items, None])], "item_id long, text string")
    found = docs(spark, [" ".join([items[i], words(30, 90 + i), items[-1 - i]]) for i in range(12)] + [None, "clean"])
    whole = sorted(map(tuple, decontamination.mark(spark, found, bench).collect()), key=str)
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 150)
    monkeypatch.setattr(decontamination, "GROUP_BYTES", 700)
    assert sorted(map(tuple, decontamination.mark(spark, found, bench).collect()), key=str) == whole and whole[0][3] == 2


def test_token_ids_equal_the_library():
    coder = tokens.encoder(tokens.vocabulary())
    r = random.Random(2)
    odd = ["".join(r.choice(["a", "b", " ", "\n", "'s", "1", "é", ".", "\xa0", "½", "日", "\t"]) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    odd += [t or "" for t in TEXTS]
    assert coder.encode(odd) == coder.whole(odd)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_shard_round_trip(kind):
    ids = [np.random.default_rng(i).integers(0, 1 << (8 * (i % 4) + 7), n, np.uint32) for i, n in enumerate((0, 1, 70_000, 9, 65_536))]
    shard = token_output.Shard(token_output.encode_shard([5, None, 7, 7, 9], [x.tobytes() for x in ids], kind))
    flat = np.concatenate(ids)
    assert (shard.read_ids() == flat).all() and shard.doc_ids == [5, None, 7, 7, 9]
    assert (shard.read_ids(65_530, 70_009) == flat[65_530:70_009]).all()


def test_token_output_and_packing(spark, tmp_path):
    table = docs(spark, TEXTS)
    whole = {i: t for i, t in zip([0, 1, 2, None, 4, 5, 6, 7, 8, 9], TEXTS, strict=True)}
    ids = {i: tokens.encoder(tokens.vocabulary()).encode([t or ""])[0] + b"\0\0\0\0" for i, t in whole.items()}
    rows = token_output.read(token_output.write(spark, table, f"file://{tmp_path}/shards", tokens.vocabulary())).collect()
    at = 0
    for row in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids[row.doc_id]) // 4, zlib.crc32(ids[row.doc_id]))
        at += row.n_tokens
    placed = collections.defaultdict(list)
    total = 0
    for r in packing.pack(spark, table, tokens.vocabulary(), 256).collect():
        assert zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
        placed[r.sequence_id].append((r.offset, r.length))
        total += r.length
    assert total == sum(len(x) // 4 for x in ids.values())
    for parts in placed.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 256
    assert packing.pack(spark, docs(spark, []), tokens.vocabulary()).count() == 0


def test_packing_plan_uses_up_the_histogram():
    r = random.Random(4)
    histogram = collections.Counter(r.randint(1, 64) for _ in range(3000))
    plan = packing.plan(histogram, 64)
    used = collections.Counter()
    for n, pattern in plan:
        for length, k in pattern.items():
            used[length] += n * k
    assert used == histogram and all(sum(p.elements()) <= 64 for _, p in plan)
    assert sum(n for n, _ in plan) <= 1.03 * sum(k * n for k, n in histogram.items()) / 64


def test_suffix_order():
    r = random.Random(3)
    for _ in range(200):
        raw = bytes(r.choice(b"ab\0") for _ in range(r.randint(1, 60)))
        assert suffix_dedup.suffix_order(np.frombuffer(raw, np.uint8), 64).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def covered(raws, size=400):
    seen, marks = {}, [np.zeros(len(r), bool) for r in raws]
    for i, raw in enumerate(raws):
        for j in range(len(raw) - size + 1):
            k = hashlib.blake2b(raw[j : j + size], digest_size=12).digest()
            if k in seen:
                for a, b in {seen[k], (i, j)}:
                    marks[a][b : b + size] = True
            else:
                seen[k] = i, j
    return marks


def test_suffix_dedup(spark):
    a, b, c = (words(150, s) for s in (11, 12, 13))
    texts = ["a" * 900, "ab" * 450, a, a[:500] + "X" + a[501:], None, "q" + b[50:600] + "z", b, "p" + c[:430] + "m" + c[200:] + c[:420], "", "é" * 300, "short", a]
    rows = suffix_dedup.dedup(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    raws = [(t or "").encode() for t in texts]
    for mark, raw, row in zip(covered(raws), raws, sorted(rows, key=lambda r: r.doc_id), strict=True):
        kept = np.frombuffer(raw, np.uint8)[~mark].tobytes()
        assert (row.n_bytes, row.n_removed, row.kept_sha256) == (len(raw), int(mark.sum()), hashlib.sha256(kept).hexdigest())


def test_suffix_dedup_of_hot_groups_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 1500)  # nearly every group is hot, and so are many of its slabs
    r = random.Random(14)
    base, other = words(120, 15), words(120, 16)
    texts = [base[:k] + chr(97 + k % 26) + base[k + 1 :] for k in range(0, 700, 35)] + [other[r.randint(0, 40) :] + words(9, 60 + i) for i in range(12)] + ["ab" * 500, "", None, base, base]
    rows = [(None if i in (2, 5) else 7 if i in (3, 4) else i, t, "x", 1) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, digest string, hash int")
    raws = [(t or "").encode() for t in texts]
    wanted = sorted((str(row[0]), len(raw), int(mark.sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~mark].tobytes()).hexdigest()) for row, raw, mark in zip(rows, raws, covered(raws), strict=True))
    assert sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.kept_sha256) for x in suffix_dedup.dedup(spark, table).collect()) == wanted
    assert suffix_dedup.dedup(spark, table.limit(0)).count() == 0


def test_suffix_dedup_of_a_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {x.doc_id: (x.text or "").encode() for x in table.collect()}
    marks = dict(zip(texts, covered(list(texts.values())), strict=True))
    for row in suffix_dedup.op3_suffix_dedup(spark, "/root/testdata/sf0.01").collect():
        kept = np.frombuffer(texts[row.doc_id], np.uint8)[~marks[row.doc_id]].tobytes()
        assert (row.n_removed, row.kept_sha256) == (int(marks[row.doc_id].sum()), hashlib.sha256(kept).hexdigest())


def test_near_dedup(spark):
    base = words(200, 21).split()
    near = [*base]
    near[50] = "changed"
    third = [*near]
    third[150] = "other"
    texts = [" ".join(base), " ".join(near), " ".join(third), None, "", " ".join(reversed(base)), "two words", words(200, 22), " ".join(base)]
    rows = near_dedup.classes(spark, docs(spark, texts)).collect()
    ids = {r.doc_id: r for r in rows}
    assert {ids[i].class_id for i in (0, 1, 2, 8)} == {0} and ids[0].class_size == 4 and ids[4].class_id == ids[None].class_id == 4
    assert sorted(r.doc_id for r in rows if r.kept) == [0, 4, 5, 6, 7]
    assert near_dedup.drop_near(spark, docs(spark, texts)).count() == 5
    assert near_dedup.classes(spark, docs(spark, [])).count() == 0


def brute_classes(texts):
    """A class number per text, from all pairs."""
    parsed = [(h, near_dedup.labelled(h, c)) for h, c in (near_dedup.shingles([t.encode()]) for t in texts)]
    root = list(range(len(texts)))

    def top(i):
        return i if root[i] == i else top(root[i])

    n_links = 0
    for i in range(len(texts)):
        for j in range(i):
            if near_dedup.similar(*parsed[i], *parsed[j]):
                root[max(top(i), top(j))], n_links = min(top(i), top(j)), n_links + 1
    return [top(i) for i in range(len(texts))], n_links


@pytest.mark.parametrize("n,least,most", [(300, 2, 6), (200, 4, 7)])
def test_near_dedup_of_hot_groups(spark, n, least, most):
    r = random.Random(n)
    base, texts = words(300, 33).split(), []
    for i in range(n):
        own = [*base]
        for at in r.sample(range(300), r.randint(least, most)):
            own[at] = f"w{i}x{at}"
        texts.append(" ".join(own))
    wanted, n_links = brute_classes(texts)
    rows = near_dedup.classes(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert n_links > 50 and len(set(wanted)) > 10
    assert {x.doc_id: x.class_id for x in rows} == dict(enumerate(wanted))
    assert {x.doc_id: x.class_size for x in rows} == {i: wanted.count(w) for i, w in enumerate(wanted)}


def test_near_dedup_in_large_buckets(spark, tmp_path, monkeypatch):
    base = words(200, 31).split()
    family = [" ".join([*base[:100], f"own{i}", *base[101:]]) for i in range(320)]
    rows = near_dedup.classes(spark, docs(spark, family)).collect()
    assert {(r.class_id, r.class_size) for r in rows} == {(0, 320)}
    # one bucket of 340 texts in all bands: 20 near copies of one text, and 160 pairs; all else is unlike, so no pivot serves
    monkeypatch.setattr(near_dedup, "BLOCK", 60)
    pairs = [" ".join([*words(60, 500 + i).split()[:-1], end]) for i in range(160) for end in ("left", "right")]
    crossed = [" ".join([*base[: 5 * i], *base[5 * i + 5 : 5 * i + 10], *base[5 * i : 5 * i + 5], *base[5 * i + 10 :]]) for i in range(20)]
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    everything = [*pairs, *crossed]
    texts = spark.createDataFrame([(digest(t), t) for t in everything], "digest binary, text string")
    nodes = spark.createDataFrame([(digest(t), int(near_dedup.shingles([t.encode()])[1][0]), list(range(near_dedup.BANDS))) for t in everything], "digest binary, n long, keys array<long>")
    got = {bytes(x.u): bytes(x.v) for x in near_dedup.linked(texts, nodes, f"file://{tmp_path}/near").collect()}
    families = collections.defaultdict(set)
    for t, c in zip(everything, brute_classes(everything)[0], strict=True):
        families[c].add(digest(t))
    assert got == {d: min(f) for f in families.values() for d in f if d != min(f)} and len(got) == 160 + 19


def test_alignment():
    r = random.Random(5)
    for _ in range(200):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert near_dedup.aligned(a, b, len(a) + len(b)) == best[-1][-1]


def test_components(spark, tmp_path):
    pairs = [(i, i + 1) for i in range(20)] + [(40, 41), (50, 41)]
    got = {(r.u, r.v) for r in components.components(spark.createDataFrame(pairs, "u long, v long"), f"file://{tmp_path}/c").collect()}
    assert got == {(i, 0) for i in range(1, 21)} | {(41, 40), (50, 40)}


def test_suffix_tree(spark):
    texts = [words(60, s) + (" The End" * (s % 3)) for s in range(30)] + ["", None, "zz\x01"]
    rows = suffix_tree_lm.score(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter(w for i, t in enumerate(texts) if not held(i) for w in [*suffix_tree_lm.tokens(t), b"\n"])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        own = [*suffix_tree_lm.tokens(texts[r.doc_id]), b"\n"]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(own), sum(w in counts for w in own), n)
        assert abs(r.base_score - sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in own)) < 1e-6
        assert r.score < 0
    empty = suffix_tree_lm.score(spark, docs(spark, [])).count()
    assert empty == 0


def test_automaton_is_a_distribution_and_finds_longest_suffixes():
    streams = [suffix_tree_lm.stream(suffix_tree_lm.tokens(words(80, s))) for s in range(40)]
    codes, counts = suffix_tree_lm.gram_counts(streams, 3)
    one = suffix_tree_lm._counted(codes & np.uint64(0xFFFF), counts)
    levels = {0: suffix_tree_lm._counted(one[0] & np.uint64(255), one[1]), 1: one} | {k: (x, n) for k, x, n in suffix_tree_lm.retained(codes, counts, one, int(counts.sum()), 3)}
    machine = suffix_tree_lm.Automaton(levels, 3)
    table = 10.0 ** machine.logs.reshape(-1, machine.width).astype(float)
    assert np.allclose(table[:, :-1].sum(1) + machine.unseen * table[:, -1], 1, atol=1e-4)
    together, alone = machine.scores(streams), [machine.scores([s])[0] for s in streams]
    assert np.allclose(together, alone, atol=1e-3)


def test_suffix_tree_grows_and_scores_in_shards(spark):
    texts = [words(200, s % 9) + " " + words(60, 70 + s) for s in range(90)]
    own = {i: suffix_tree_lm.stream(suffix_tree_lm.tokens(t)) for i, t in enumerate(texts)}
    codes, counts = suffix_tree_lm.gram_counts([s for i, s in own.items() if zlib.crc32(str(i).encode()) % 7 != 2])
    one = suffix_tree_lm._counted(codes & np.uint64(0xFFFF), counts)
    kept, larger = (suffix_tree_lm.retained(codes, counts, one, n) for n in (int(counts.sum()), 10**11))
    assert sum(len(x) for _, x, _ in kept) > 0 and [x.tolist() for _, x, _ in kept] == [x.tolist() for _, x, _ in larger]
    levels = {0: suffix_tree_lm._counted(one[0] & np.uint64(255), one[1]), 1: one} | {k: (x, n) for k, x, n in kept}
    wanted = suffix_tree_lm.Automaton(levels).scores(list(own.values()))
    rows = suffix_tree_lm.score(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert len(rows) == 90 and all(abs(r.score - wanted[r.doc_id]) < 1e-2 for r in rows)


def test_suffix_tree_blocks_hold_every_place_in_few_bytes():
    r = random.Random(4)
    prose = [suffix_tree_lm.stream(suffix_tree_lm.tokens(" ".join(r.choices(words(300, 1).split(), k=120)))) for _ in range(400)]
    odd = [bytes(r.choice([x for x in range(256) if x != 10]) for _ in range(r.randrange(40))) + b"\n" for _ in range(600)]  # codes and rows of more than 64 bits
    for streams in (prose, odd, [b"\n"], [b"a\n"] * 70_000):
        blocks, got = list(suffix_tree_lm._places(streams, 13)), collections.Counter()
        for shard, blob, rows in blocks:
            codes, counts = suffix_tree_lm._unpacked(blob)
            assert set(suffix_tree_lm._shards(codes, 13).tolist()) == {shard} and (codes[1:] > codes[:-1]).all()
            got.update(zip(np.repeat(codes, counts).tolist(), suffix_tree_lm._unpacked_rows(rows, counts, len(streams)).tolist(), strict=True))
        of = np.repeat(np.arange(len(streams)), [len(s) for s in streams])
        assert got == collections.Counter(zip(suffix_tree_lm.gram_codes(streams).tolist(), of.tolist(), strict=True))
        if streams is prose:
            assert sum(len(rows) for _, _, rows in blocks) < 1.05 * len(of)  # 1.18 as plain rows, 0.97 as steps


def edits(a, b):
    """Optimal-string-alignment distance, by the table."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_lexicon_finds_what_the_distance_table_finds():
    r = random.Random(12)
    word = lambda n: "".join(r.choice("abc") for _ in range(n))
    terms = sorted({word(r.randint(2, 9)) for _ in range(60)})
    lexicon = toxicity.Lexicon(terms)
    for w in {word(r.randint(1, 10)) for _ in range(1500)} | {""}:
        near = [(i, 1) for i, t in enumerate(terms) if len(t) >= toxicity.SHORTEST_FUZZY and edits(w, t) == 1]
        assert sorted(lexicon.near(w)) == ([(terms.index(w), 0)] if w in terms else near)


def test_classifiers(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        bad, toxic = i % 3 == 0, i % 4 == 0
        own = [w + ("!!" if bad else "") for w in words(40, 100 + i).split()]
        if toxic:
            own.insert(r.randint(0, 39), "nastyword" if i % 8 else "badterm")
        rows.append((i, " ".join(own)))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(900, "they wrote nastywort here"), (901, 'the word " nastyword " is rude'), (902, ""), (903, None)]
    docs_, labels_ = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.score(spark, docs_, labels_).collect()}
    assert all(got[i].predicted == t for i, _, t in labels)
    assert got[900].score > got[902].score and got[901].score < got[900].score and got[903].score == got[902].score
    q = {x.doc_id: x for x in quality.score(docs_, labels_).collect()}
    assert sum(q[i].score > 0.5 for i, good, _ in labels if good) > 190 and sum(q[i].score < 0.5 for i, good, _ in labels if not good) > 90
    assert 0 <= q[902].score <= 1 and q[902].score == q[903].score
    assert {x.score for x in toxicity.score(spark, docs_, labels_.limit(0)).collect()} == {0.0}
    assert {x.score for x in quality.score(docs_, labels_.limit(0)).collect()} == {0.5}
