"""Compression classifier of text quality.

Two zstandard dictionaries are built from good and bad labelled text. A text is compressed
in chunks of ``CHUNK`` bytes with either dictionary; the difference of the two compressed
sizes by its length, calibrated by a logistic regression on labelled rows that built no
dictionary, is the score. All bytes of every text are compressed.

The fit uses at most ``SAMPLE_ROWS`` labelled rows. Half of them build the dictionaries, each
with up to ``DRAWN`` chunks from its beginning to its end; the other half's sizes for the
calibration are taken on the executors over all their bytes, and two numbers a row come back.

Defined results: null and empty texts have a difference of 0 and so the score that the
calibration gives to no evidence; without labels of both classes every score is the share
of label 1 (0.5 without any); repeated rows get repeated results; an empty table gives an
empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import classify, shared

SAMPLE_ROWS = 8000
CHUNK = 2048
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
THRESHOLD = 0.3
#: Chunks of a text that build a dictionary, drawn at equal distances from all of it, so that long texts don't make up most of one.
DRAWN = 8


def _chunks(raw: bytes) -> list[bytes]:
    return [raw[at : at + CHUNK] for at in range(0, len(raw), CHUNK)]


def _drawn(raw: bytes) -> list[bytes]:
    chunks = _chunks(raw)
    return chunks if len(chunks) <= DRAWN else [chunks[i * (len(chunks) - 1) // (DRAWN - 1)] for i in range(DRAWN)]


def _dictionary(parts: list[bytes]) -> bytes:
    """A trained dictionary; the last bytes themselves where there is too little text to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY_BYTES:]


class Scorer:
    def __init__(self, good: bytes, bad: bytes, weights: list[float]):
        self.state, self.ends = (good, bad, weights), []
        for raw in (good, bad):
            data = zstandard.ZstdCompressionDict(raw)
            data.precompute_compress(level=LEVEL)
            self.ends.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False).compress)
        self.weights = np.array(weights)

    def features(self, raw: bytes) -> tuple[float, float]:
        good, bad = (sum(len(squeeze(c)) for c in _chunks(raw)) for squeeze in self.ends)
        n = len(raw)
        return 10 * (bad - good) / max(n, 1), 10 * (bad - good) / (n + 400)

    def scores(self, raws: list[bytes]) -> np.ndarray:
        if not raws:
            return np.zeros(0)
        return classify.probability(self.weights[0] + np.array([self.features(r) for r in raws]) @ self.weights[1:])


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Scorer | float:
    """A scorer, or the one score that there is without labels of both classes."""
    sample = classify.labelled_sample(docs, labels, "quality", 5, 0, rows).select("doc_id", "label", "text")
    sample = shared.written(sample, f"{shared.work_dir(docs.sparkSession, 'quality')}/sample")
    ids = sorted((r["label"], r["doc_id"]) for r in sample.select("label", "doc_id").distinct().collect())  # at most ``rows``
    if len({label for label, _ in ids}) < 2:
        return float(ids[0][0]) if ids else 0.5
    of = {label: [i for own, i in ids if own == label] for label in (0, 1)}
    builds = {i for own in of.values() for i in (own[::2] if len(own) > 1 else own)}
    rest = [i for own in of.values() for i in own[1::2]]
    rest = set(rest if all(len(own) > 1 for own in of.values()) else [i for _, i in ids])

    def drawn(frames):
        import pyarrow as pa

        for frame in frames:
            parts = [_drawn(text.encode()) for text in frame.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1), pa.array(parts, pa.list_(pa.binary()))], ["doc_id", "label", "parts"])

    rows_ = sample.where(F.col("doc_id").isin(*builds)).select("doc_id", "label", "text").mapInArrow(drawn, "doc_id long, label int, parts array<binary>")
    found = sorted((r["doc_id"], r["label"], [bytes(c) for c in r["parts"]]) for r in rows_.toLocalIterator())
    good, bad = (_dictionary([c for _, own, parts in found if own == label for c in parts]) for label in (1, 0))

    def sizes(frames):
        import pyarrow as pa

        raw = Scorer(good, bad, [0, 0, 0])
        for frame in frames:
            x = [raw.features(text.encode()) for text in frame.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([frame.column(0), *[pa.array([v[k] for v in x], pa.float64()) for k in (0, 1)]], ["label", "a", "b"])

    table = np.array(sorted(map(tuple, sample.where(F.col("doc_id").isin(*rest)).select("label", "text").mapInArrow(sizes, "label int, a double, b double").collect())))
    return Scorer(good, bad, classify.logistic(table[:, 1:], table[:, 0], ridge=0.1).tolist())


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    fitted = fit(docs, labels)
    state = fitted if isinstance(fitted, float) else fitted.state  # two dictionaries of a fixed size

    def run(frames):
        import pyarrow as pa

        scorer = None if isinstance(state, float) else Scorer(*state)
        for frame in frames:
            found = [np.zeros(0)]
            for at in range(0, frame.num_rows, 500):
                raws = [(t or "").encode() for t in frame.column(2).slice(at, 500).to_pylist()]
                found.append(np.full(len(raws), state) if scorer is None else scorer.scores(raws))
            scores = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype("i4"))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), classify.held_out("doc_id", 5, 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
