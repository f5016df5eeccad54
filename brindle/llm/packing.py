"""Best-fit packing of documents into sequences by exact-complement hashing.

Documents become pieces of at most ``capacity`` ids. What is packed is the histogram of
piece lengths, which has at most ``capacity`` rows at any scale: sums of one, two and three
available lengths are indexed (as bit sets, which answer every sum at once), the longest
length left opens a sequence, and a combination that fills its gap exactly is consumed as
often as the counts allow; where none exists the longest length that fits goes in. Every
step exhausts a length, so a plan has at most ``capacity`` patterns. Pieces then find their
place by their rank among the pieces of their length: the rank in their own task plus the
earlier tasks' counts, so no length, however common, meets in one task.

Defined results: a null or empty text is its end id alone; null and repeated ids are packed
like any other row; an empty table gives an empty table; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm import shared, tokens

CAPACITY = 2048


class LengthSums:
    """Which one, two or three available lengths add up to a gap."""

    def __init__(self, counts: list[int]):
        self.size = len(counts) - 1
        self.left = list(counts)
        self.mask = sum(1 << length for length, n in enumerate(counts) if n and length)
        self.mirror = sum(1 << self.size - length for length, n in enumerate(counts) if n and length)

    def take(self, length: int, n: int = 1) -> None:
        self.left[length] -= n
        if not self.left[length]:
            self.mask &= ~(1 << length)
            self.mirror &= ~(1 << self.size - length)

    def give(self, length: int) -> None:
        self.left[length] += 1
        self.mask |= 1 << length
        self.mirror |= 1 << self.size - length

    def longest(self, most: int) -> int:
        return (self.mask & (1 << most + 1) - 1).bit_length() - 1

    def pair(self, gap: int) -> tuple[int, ...]:
        found = self.mask & self.mirror >> self.size - gap
        while found:
            one = found.bit_length() - 1
            if 2 * one != gap or self.left[one] > 1:
                return one, gap - one
            found &= ~(1 << one)
        return ()

    def exact(self, gap: int) -> tuple[int, ...]:
        if self.mask >> gap & 1:
            return (gap,)
        if two := self.pair(gap):
            return two
        one = self.longest(gap - 2) if gap > 2 else -1
        while one > 0:
            self.take(one)
            two = self.pair(gap - one)
            self.give(one)
            if two:
                return one, *two
            one = self.longest(one - 1)
        return ()


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, Counter]]:
    """(times, lengths of one sequence) patterns that use up the histogram."""
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    sums, patterns = LengthSums(counts), []
    while sums.mask:
        used, gap = Counter(), capacity
        piece = sums.longest(gap)
        while piece > 0:
            used[piece] += 1
            sums.take(piece)
            gap -= piece
            if gap and (rest := sums.exact(gap)):
                for piece in rest:
                    used[piece] += 1
                    sums.take(piece)
                gap = 0
            piece = sums.longest(gap) if gap else 0
        more = min(sums.left[length] // n for length, n in used.items())
        for length, n in used.items():
            if more:
                sums.take(length, more * n)
        patterns.append((more + 1, used))
    return patterns


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece, with its task and its rank there among pieces of its length."""

    def cut(frames):
        import pyarrow as pa
        from pyspark import TaskContext

        coder, part = tokens.encoder(vocabulary), TaskContext.get().partitionId()
        end, ranks = np.uint32(tokens.END_ID).tobytes(), [0] * (capacity + 1)
        for frame in frames:
            names, texts, rows = frame.column(0).to_pylist(), frame.column(1), []
            for at in range(0, len(names), 256):
                for doc_id, coded in zip(names[at : at + 256], coder.encode(texts.slice(at, 256).to_pylist()), strict=True):
                    ids = coded + end
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    for piece, start in enumerate([0, *range(first, n, capacity)]):
                        length = first if not piece else capacity
                        rows.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, ranks[length]))
                        ranks[length] += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long")


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    at = shared.work_dir(spark, "packing")
    cut = shared.written(pieces(docs, vocabulary, capacity, id_col, text_col), f"{at}/pieces")
    own = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    own = shared.written(own, f"{at}/counts")
    histogram = {r["length"]: r["n"] for r in own.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    keys, bases, times, offsets, sequence = [], [], [], [], 0
    ranks: Counter = Counter()
    for n, used in plan(histogram, capacity):
        offset = 0
        for length, k in sorted(used.items(), reverse=True):
            keys.append(length << 44 | ranks[length])
            bases.append(sequence)
            times.append(k)
            offsets.append(offset)
            ranks[length] += n * k
            offset += k * length
        sequence += n
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    table = [np.array(x, np.int64)[order] for x in (keys, bases, times, offsets)]

    def place(frames):
        import pyarrow as pa

        key, base, k, offset = table
        for frame in frames:
            length, rank = frame.column("length").to_numpy(zero_copy_only=False), frame.column("rank").to_numpy(zero_copy_only=False)
            row = np.searchsorted(key, length << 44 | rank, side="right") - 1
            turn = rank - (key[row] & (1 << 44) - 1)
            arrays = [frame.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            arrays += [pa.array(base[row] + turn // k[row], pa.int64()), pa.array(offset[row] + turn % k[row] * length, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = own.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # Counts have a row per task and length, so they are merged and not broadcast.
    ranked = cut.join(before.hint("merge"), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), tokens.vocabulary())
