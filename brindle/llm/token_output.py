"""Token ids in bit-plane shards.

A shard holds the ids of consecutive documents. Ids are cut into blocks of ``BLOCK``; each
block is transposed into byte planes (or bit planes), each plane is compressed by zstandard
on its own, and planes that are all zero take no room. The chunk index after the planes
gives every block's place, so ``read_ids`` decodes only the blocks it needs.

    shard  = b"BPL1" | planes of block 0 | planes of block 1 | ... | index | footer
    index  = zstandard of int64: kind, n_ids, n_docs, n_blocks, then for each block its
             offset and its planes' sizes, then doc_ids, null flags and lengths
    footer = int64 offset and size of the index | b"BPL1"

Documents are range-partitioned and sorted by id, so the shards in order hold the ids in
ascending order of doc_id. A task writes a shard under a name of its own attempt and then
moves it, so a retry replaces a shard by equal bytes.

Defined results: a null or empty text is its end id alone; a null id sorts first; rows that
repeat an id are kept, ordered by text; an empty table makes no shard and gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm import shared, tokens

MAGIC = b"BPL1"
BLOCK = 1 << 16
#: Ids of a shard at most, unless a single document has more.
SHARD_IDS = 8_000_000
KINDS = ("byte", "bit")


def _planes(ids: np.ndarray, kind: str) -> list[bytes]:
    by_byte = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    rows = by_byte if kind == "byte" else np.packbits(np.unpackbits(by_byte.reshape(4, -1, 1), axis=2, bitorder="little").transpose(0, 2, 1).reshape(32, -1), axis=1)
    return [row.tobytes() if row.any() else b"" for row in rows]


def _ids(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    width = n if kind == "byte" else -(-n // 8)
    rows = np.stack([np.frombuffer(p, np.uint8) if p else np.zeros(width, np.uint8) for p in planes])
    if kind == "bit":
        bits = np.unpackbits(rows, axis=1)[:, :n].reshape(4, 8, n).transpose(0, 2, 1)
        rows = np.packbits(bits, axis=2, bitorder="little").reshape(4, n)
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


def encode_shard(doc_ids: list[int | None], ids: list[bytes], kind: str = "byte", level: int = 3) -> bytes:
    """A shard of the documents' ids, given as little-endian unsigned 32-bit bytes."""
    squeeze = zstandard.ZstdCompressor(level=level)
    flat = np.frombuffer(b"".join(ids), "<u4")
    parts, at, blocks = [MAGIC], len(MAGIC), []
    for first in range(0, len(flat), BLOCK):
        planes = [squeeze.compress(p) if p else b"" for p in _planes(flat[first : first + BLOCK], kind)]
        blocks += [at, *map(len, planes)]
        parts += planes
        at += sum(map(len, planes))
    n_planes = 4 if kind == "byte" else 32
    head = [KINDS.index(kind), len(flat), len(doc_ids), len(blocks) // (1 + n_planes)]
    index = squeeze.compress(np.array([*head, *blocks, *[d or 0 for d in doc_ids], *[d is None for d in doc_ids], *[len(x) // 4 for x in ids]], "<i8").tobytes())
    return b"".join([*parts, index, np.array([at, len(index)], "<i8").tobytes(), MAGIC])


class Shard:
    """A shard read back: ``doc_ids``, ``lengths`` and any range of its ids."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC or data[-4:] != MAGIC:
            raise ValueError("not a bit-plane shard")
        at, size = np.frombuffer(data[-20:-4], "<i8")
        index = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at : at + size]), "<i8")
        self.data, self.kind, self.n_ids, n_docs, n_blocks = data, KINDS[index[0]], int(index[1]), int(index[2]), int(index[3])
        width = 5 if self.kind == "byte" else 33
        self.blocks = index[4 : 4 + n_blocks * width].reshape(n_blocks, width)
        ids, nulls, self.lengths = index[4 + n_blocks * width :].reshape(3, n_docs)
        self.doc_ids = [None if null else int(d) for d, null in zip(ids, nulls, strict=True)]

    def read_ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if stop <= start:
            return np.zeros(0, "<u4")
        out = []
        for block in range(start // BLOCK, -(-stop // BLOCK)):
            at, *sizes = self.blocks[block].tolist()
            planes = []
            for size in sizes:
                planes.append(zstandard.ZstdDecompressor().decompress(self.data[at : at + size]) if size else b"")
                at += size
            out.append(_ids(planes, min(BLOCK, self.n_ids - block * BLOCK), self.kind))
        first = start // BLOCK * BLOCK
        return np.concatenate(out)[start - first : stop - first]


def write(spark: SparkSession, docs: DataFrame, folder: str, vocabulary: str, kind: str = "byte", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards into ``folder``; returns the manifest: part, shard, path, n_docs, n_tokens."""

    def shards(frames):
        import pyarrow as pa
        from pyspark import TaskContext

        task, coder = TaskContext.get(), tokens.encoder(vocabulary)
        part, end, number = task.partitionId(), np.uint32(tokens.END_ID).tobytes(), 0
        doc_ids, ids, size = [], [], 0

        def flush():
            path = f"{folder}/part-{part:06d}-{number:05d}.bpl"
            shared.put_file(path, encode_shard(doc_ids, ids, kind), f"{task.stageId()}-{task.taskAttemptId()}")
            return pa.RecordBatch.from_pydict({"part": [part], "shard": [number], "path": [path], "n_docs": [len(ids)], "n_tokens": [size]})

        for frame in frames:
            names, texts = frame.column(0).to_pylist(), frame.column(1)
            for at in range(0, len(names), 256):
                for doc_id, coded in zip(names[at : at + 256], coder.encode(texts.slice(at, 256).to_pylist()), strict=True):
                    if ids and size + len(coded) // 4 + 1 > SHARD_IDS:
                        yield flush()
                        doc_ids, ids, size, number = [], [], 0, number + 1
                    doc_ids.append(doc_id)
                    ids.append(coded + end)
                    size += len(coded) // 4 + 1
        if ids:
            yield flush()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    made = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(shards, "part long, shard long, path string, n_docs long, n_tokens long")
    return shared.written(made, f"{folder}/manifest")


def read(manifest: DataFrame) -> DataFrame:
    """One row per document, from the shards: doc_id, start, n_tokens, ids_crc32."""

    def documents(frames):
        import pyarrow as pa

        for frame in frames:
            for path, begin in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                shard = Shard(shared.get_file(path))
                raw, ends = shard.read_ids().tobytes(), np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                crcs = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(starts + begin, pa.int64()), pa.array(shard.lengths, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard, not per document
    placed = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("begin"))
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(parts, "path").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read(write(spark, docs, shared.work_dir(spark, "token-output"), tokens.vocabulary()))
