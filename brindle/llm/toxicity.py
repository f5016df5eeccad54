"""Toxicity scores from a lexicon trie intersected with Levenshtein automata.

The lexicon is learned: words whose document counts in toxic and other labelled rows differ
by a likelihood-ratio test of ``EVIDENCE``. Those that pass with near copies counted about
once, too, are kept as a trie. Each new word of a text
becomes a bit-parallel Levenshtein automaton, which walks the trie and finds the terms
within one edit or swap of neighbours, so misspelled terms count too. Around each hit a window of ``CONTEXT``
words tells quotation (quotation marks, words about words) from abuse. The weights of exact,
misspelled and quoted hits come from a logistic regression on labelled rows.

The fit uses at most ``SAMPLE_ROWS`` labelled rows, which bounds what is sent to the executors;
every word of them that passes the test is a term. Scoring covers every word of every text.

Defined results: null and empty texts have no hits and so the score of a text without
evidence; without labels of both classes every score is the share of label 1 (0 without
any); repeated rows get repeated results; an empty table gives an empty table; other
columns are ignored by ``score`` and kept by ``drop_toxic``, whatever their names.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import classify, shared

SAMPLE_ROWS = 20_000
EVIDENCE = 20.0
CONTEXT = 4
#: Terms shorter than this match only exactly.
SHORTEST_FUZZY = 4
THRESHOLD = 0.3
#: Words that a worker remembers as harmless; when there are more it starts anew.
CACHE_WORDS = 400_000
WORD = r"[^\W_]+(?:[@$!*'][^\W_]+)*"
_SPLIT = re.compile(WORD + r"|[\"“”«»„‘’]").findall
_JAVA_WORD = r"[\p{L}\p{N}]+(?:[@$!*'][\p{L}\p{N}]+)*"
_MARKS = frozenset("\"“”«»„‘’")
_SAYING = frozenset(("said", "says", "word", "words", "term", "called", "quote", "quoted", "quotes", "dit", "mot", "wort", "sagte", "palabra", "dijo"))


class Lexicon:
    """Terms as a trie; ``near(word)`` gives the terms within an edit, with their distances."""

    def __init__(self, terms: list[str], varied: frozenset[int] | None = None):
        """varied: the terms that are sought misspelled, too; all if None."""
        self.trie: dict = {}
        self.terms = {t: i for i, t in enumerate(terms)}
        heads: dict[int, set[str]] = {}
        tails: dict[int, set[str]] = {}
        self.crossed: set[tuple[str, str]] = set()  # what a swap across the middle leaves as it is
        sought = [(i, t) for i, t in enumerate(terms) if varied is None or i in varied]
        self.short = {t for _, t in sought if len(t) == SHORTEST_FUZZY}
        self.gaps = {(t[:i], t[i + 1 :]) for t in self.short for i in range(len(t))}  # short terms less a letter
        self.less = {a + b for a, b in self.gaps}
        for i, term in sought:
            node = self.trie
            for letter in term:
                node = node.setdefault(letter, {})
            node[""] = i
            if len(term) > SHORTEST_FUZZY:  # one edit leaves the first or the second half as it is
                half = len(term) // 2
                self.crossed.add((term[: half - 1], term[half + 1 :]))
                for length in (len(term) - 1, len(term), len(term) + 1):
                    heads.setdefault(length, set()).add(term[:half])
                    tails.setdefault(length, set()).add(term[half:])
        self.halves = {n: ([(k, {x for x in heads[n] if len(x) == k}) for k in {*map(len, heads[n])}], [(k, {x for x in tails[n] if len(x) == k}) for k in {*map(len, tails[n])}]) for n in heads}

    def possible(self, word: str) -> bool:
        """Whether a term of about the word's length shares its first or its second half with it.

        Halves of the shortest terms say little, so those are looked up less each letter.
        """
        n = len(word)
        if n == SHORTEST_FUZZY - 1 and word in self.less:
            return True
        if n == SHORTEST_FUZZY and any((word[:i], word[i + 1 :]) in self.gaps or word[:i] + word[i + 1 : i + 2] + word[i : i + 1] + word[i + 2 :] in self.short for i in range(n)):
            return True
        if n == SHORTEST_FUZZY + 1 and any(word[:i] + word[i + 1 :] in self.short for i in range(n)):
            return True
        if halves := self.halves.get(len(word)):
            for n, own in halves[0]:
                if word[:n] in own:
                    return True
            for n, own in halves[1]:
                if word[-n:] in own:
                    return True
        half = n // 2
        return half > 0 and (word[: half - 1], word[half + 1 :]) in self.crossed

    def near(self, word: str) -> list[tuple[int, int]]:
        """(term, distance) for distances 0 and 1: the word's automaton runs along the trie.

        Bit j of a state stands for j letters of the word read: with no edit, with at most one, and
        with none but the next two letters swapped.
        """
        if word in self.terms:
            return [(self.terms[word], 0)]
        if not self.possible(word):
            return []
        places: dict[str, int] = {}
        for j, letter in enumerate(word):
            places[letter] = places.get(letter, 0) | 1 << j
        end, found = 1 << len(word), []
        stack = [(self.trie, 1, 0b11, 0, 0)]
        while stack:
            node, none, one, swap, depth = stack.pop()
            for letter, child in node.items():
                if letter == "":
                    if one & end and depth >= SHORTEST_FUZZY:
                        found.append((child, 1))
                    continue
                at = places.get(letter, 0)
                none_next = (none & at) << 1
                one_next = (one & at) << 1 | none | none << 1 | none_next << 1 | (swap & at) << 2
                if one_next & (end << 1) - 1:
                    stack.append((child, none_next, one_next & (end << 1) - 1, none & at >> 1, depth + 1))
        return found


class Scorer:
    def __init__(self, terms: list[str], varied: frozenset[int], exact: list[float], fuzzy: list[float], weights: list[float]):
        self.state = terms, varied, exact, fuzzy, weights
        self.lexicon, self.exact, self.fuzzy, self.weights = Lexicon(terms, varied), exact, fuzzy, np.array(weights)
        self.bad: dict[str, tuple[float, float]] = {}
        self.bad_chunks: set[str] = set()
        self.fine: set[str] = set()

    def _learn(self, chunks: set[str]) -> None:
        """Sorts what stands between white space into chunks with and without a word near a term."""
        if len(self.fine) > CACHE_WORDS:
            self.fine.clear()
        for chunk in chunks:
            hit = False
            for word in (chunk,) if chunk.isalnum() else _SPLIT(chunk):
                if word in self.bad:
                    hit = True
                elif word in self.lexicon.terms or self.lexicon.possible(word):
                    hits = self.lexicon.near(word)
                    exact = max([self.exact[t] for t, d in hits if d == 0], default=0.0)
                    fuzzy = 0.0 if exact else max([self.fuzzy[t] for t, d in hits], default=0.0)
                    if exact or fuzzy > 0:
                        self.bad[word], hit = (exact, fuzzy), True
            (self.bad_chunks if hit else self.fine).add(chunk)

    def features(self, text: str) -> tuple[float, ...]:
        text = text.lower()
        own = set(text.split())  # no word and no mark holds white space
        if new := own - self.fine:
            if new := new - self.bad_chunks:
                self._learn(new)
        if own.isdisjoint(self.bad_chunks):
            return (0.0,) * 6
        words = _SPLIT(text)
        exact = fuzzy = quoted = 0.0
        n_exact = n_fuzzy = 0
        for i, word in enumerate(words):
            if hit := self.bad.get(word):
                around = words[max(0, i - CONTEXT) : i + CONTEXT + 1]
                if any(w in _MARKS for w in around[: CONTEXT + 1]) and any(w in _MARKS for w in around[-CONTEXT:]) or any(w in _SAYING for w in around):
                    quoted += hit[0] + hit[1]
                else:
                    exact, fuzzy = exact + hit[0], fuzzy + hit[1]
                    n_exact, n_fuzzy = n_exact + (hit[0] > 0), n_fuzzy + (hit[1] > 0)
        return min(exact, 20) / 5, float(n_exact > 0), min(fuzzy, 20) / 5, float(n_fuzzy > 0), min(quoted, 20) / 5, 100 * n_exact / (len(words) + 50)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return classify.probability(self.weights[0] + np.array([self.features(t) for t in texts]) @ self.weights[1:])


def _odds(pos: float, neg: float, n_pos: float, n_neg: float) -> float:
    return math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Scorer | float:
    """A scorer, or the one score that there is without labels of both classes."""
    at = shared.work_dir(spark, "toxicity")
    sample = shared.written(classify.labelled_sample(docs, labels, "toxic", 4, 2, rows), f"{at}/sample")
    # Near copies share their least word hash. Only terms that also pass with such clusters counted once are sought misspelled.
    own = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_JAVA_WORD), F.lit(0)))
    sets = shared.written(sample.select("label", own.alias("words")).withColumn("cluster", F.coalesce(F.expr("array_min(transform(words, w -> xxhash64(w)))"), F.lit(0).cast("long"))), f"{at}/sets")
    counts = {r["label"]: (r["n"], r["c"]) for r in sets.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cluster").alias("c")).collect()}
    (n_pos, c_pos), (n_neg, c_neg) = counts.get(1, (0, 0)), counts.get(0, (0, 0))
    if not n_pos or not n_neg:
        return float(bool(n_pos))
    words = sets.select("label", "cluster", F.explode("words").alias("word")).groupBy("word", "label", "cluster").agg(F.count(F.lit(1)).alias("n"))
    sums = {"pos": F.col("n") * F.col("label"), "neg": F.col("n") * (1 - F.col("label")), "c_pos": F.col("label"), "c_neg": 1 - F.col("label")}
    words = shared.written(words.groupBy("word").agg(*[F.sum(c).alias(name) for name, c in sums.items()]), f"{at}/words")

    def evidence(pos: str, neg: str, n_pos: int, n_neg: int) -> str:
        """Twice the log-likelihood ratio of a word's counts against the classes' shares; 0 where it is no toxic sign."""
        share = n_pos / (n_pos + n_neg)
        ratio = f"2 * ({pos} * ln({pos} / (({pos} + {neg}) * {share!r}D)) + IF({neg} > 0, {neg} * ln({neg} / (({pos} + {neg}) * {1 - share!r}D)), 0))"
        return f"IF({pos} >= 3 AND {pos} * {n_neg} > 4 * {neg} * {n_pos}, {ratio}, 0)"

    told = words.select("word", "pos", "neg", F.expr(evidence("pos", "neg", n_pos, n_neg)).alias("texts"), F.expr(evidence("c_pos", "c_neg", c_pos, c_neg)).alias("clusters"))
    signs = sorted(told.where(f"length(word) >= 3 AND texts >= {EVIDENCE}").collect(), key=lambda r: r["word"])  # words of at most ``rows`` texts
    terms, exact = [r["word"] for r in signs], [_odds(r["pos"], r["neg"], n_pos, n_neg) for r in signs]
    varied = frozenset(i for i, r in enumerate(signs) if r["clusters"] >= EVIDENCE)

    def misspelled(frames):
        import pyarrow as pa

        lexicon = Lexicon(terms, varied)
        for frame in frames:
            hits = [(t, p, n) for w, p, n in zip(*[c.to_pylist() for c in frame.columns], strict=True) for t, d in lexicon.near(w) if d]
            yield pa.RecordBatch.from_pydict({k: [h[i] for h in hits] for i, k in enumerate(("term", "pos", "neg"))}, schema=pa.schema([(k, pa.int64()) for k in ("term", "pos", "neg")]))

    near = words.select("word", "pos", "neg").mapInArrow(misspelled, "term long, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()
    seen = {r["term"]: (r["pos"], r["neg"]) for r in near}
    # A term's misspellings start from half its own weight and lose it as they show up in harmless rows.
    fuzzy = []
    for i, odds in enumerate(exact):
        pos, neg = seen.get(i, (0, 0))
        fuzzy.append(max(0.0, min(odds, math.log((pos + 1.5) / (n_pos + 1)) - math.log((neg + 1.5) / (n_neg + 1)) if pos + neg > 3 else odds / 2)))

    def features(frames):
        import pyarrow as pa

        scorer = Scorer(terms, varied, exact, fuzzy, [0] * 7)
        for frame in frames:
            rows = [[float(label), *scorer.features(text)] for text, label in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], ["x"])

    table = np.array([r["x"] for r in sample.select("text", "label").mapInArrow(features, "x array<double>").collect()])  # at most ``rows`` of them
    weights = classify.logistic(table[:, 1:], table[:, 0], ridge=0.5)
    if not weights[3:5].any():
        weights[3] = weights[1] / 2  # no misspelling among the labelled rows: half an exact hit's weight
    return Scorer(terms, varied, exact, fuzzy, weights.tolist())


def _scorer(state) -> Scorer:
    """This worker's scorer, with the words it has met."""
    return shared.remembered(("toxicity", repr(state)), lambda: Scorer(*state))


def _scored(frame, text_at: int, state) -> np.ndarray:
    found = [np.zeros(0)]
    for at in range(0, frame.num_rows, 500):
        texts = [t or "" for t in frame.column(text_at).slice(at, 500).to_pylist()]
        found.append(np.full(len(texts), state) if isinstance(state, float) else _scorer(state).scores(texts))
    return np.concatenate(found)


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    fitted = fit(spark, docs, labels)
    state = fitted if isinstance(fitted, float) else fitted.state  # a lexicon of words of a bounded sample

    def run(frames):
        import pyarrow as pa

        for frame in frames:
            scores = _scored(frame, 2, state)
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype("i4"))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), classify.held_out("doc_id", 4, 2).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows that score below the threshold, with all their columns."""
    fitted = fit(spark, docs, labels)
    state = fitted if isinstance(fitted, float) else fitted.state
    at = docs.columns.index(text_col)

    def run(frames):
        import pyarrow as pa

        for frame in frames:
            yield frame.filter(pa.array(_scored(frame, at, state) < threshold))

    names = [f"c{i}" for i in range(len(docs.columns))]
    wide = docs.toDF(*names)
    return wide.mapInArrow(run, wide.schema).toDF(*docs.columns)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
