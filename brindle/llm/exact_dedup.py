"""Exact deduplication as a stateful stream [native].

The keyed state lives in RocksDB below the shared checkpoint folder and never expires. It
holds, for each SHA-256 digest, the stable identifier and content locator (the file) of the
row that stays, and the number of rows. State is a Structured Streaming aggregation, so a
copy group of any size is combined before the shuffle. The whole texts of rows that hit an
occupied digest are then compared; digests that hide different texts are split by the texts
themselves. The locator tells a caller where the row that stays is read from.

Defined results: a null text is the empty text; of equal texts the largest id stays (a null
id is smaller than any other); rows that repeat both id and text are one document read more
than once, so they share one verdict, and ``drop_copies`` keeps one of them; an empty table
gives an empty table; other columns are ignored by ``dedup`` and kept by ``drop_copies``,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import shared

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",  # for all stores of an executor; the rest of the state is on disk
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition's store reserves megabytes of disk
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, locator) of every row."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(F.coalesce(text_col, F.lit("")).cast("binary"), 256)).alias("digest"),
        F.input_file_name().alias("locator"),
    )


def update_state(spark: SparkSession, digest_path: str, state_path: str, schema) -> DataFrame:
    """Streams digest files not seen before into the state at ``state_path``.

    Returns one row for each digest of all runs so far: digest, keeper (doc_id, locator),
    group_size. Call it again with the same paths after adding files to go on from the state.
    """
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for key, value in ROCKSDB.items():
        spark.conf.set(key, value)
    changes = f"{state_path}/changes"
    try:
        grouped = (
            spark.readStream.schema(schema).parquet(digest_path).groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
        )
        query = (
            grouped.writeStream.outputMode("update").option("checkpointLocation", f"{state_path}/stream").trigger(availableNow=True)
            .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{changes}/batch={number}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    state_schema = grouped.schema
    if not query.lastProgress:
        return spark.createDataFrame([], state_schema)
    return spark.read.schema(state_schema).parquet(f"{changes}/batch=*").groupBy("digest").agg(F.max("keeper").alias("keeper"), F.max("group_size").alias("group_size"))


def _collisions(docs: DataFrame, state: DataFrame) -> DataFrame:
    """Digests that hide different texts, found by comparing all bytes of the rows that hit an occupied digest.

    Equal texts are combined before the shuffle, so a copy group of any size sends a text per task.
    """
    hit = shared.broadcast_within(state.where("group_size > 1").select("digest"), 60)
    texts = docs.join(hit, "digest", "left_semi").groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"))
    return texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")


def dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    at = shared.work_dir(spark, "exact-dedup")
    marked = shared.written(digests(docs, id_col, text_col), f"{at}/digests")
    state = shared.written(update_state(spark, f"{at}/digests", f"{at}/state", marked.schema), f"{at}/final")
    full = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), F.unhex(F.sha2(F.coalesce(text_col, F.lit("")).cast("binary"), 256)).alias("digest")
    )
    narrow = marked.select("doc_id", "digest")
    verdict = state.select("digest", F.col("keeper.doc_id").alias("keep_id"), "group_size")
    collided = shared.written(_collisions(full, state), f"{at}/collisions")
    if collided.isEmpty():
        joined = narrow.join(verdict, "digest")
    else:
        joined = narrow.join(collided, "digest", "left_anti").join(verdict, "digest")
        split = full.join(collided, "digest")
        by_text = split.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        joined = joined.unionByName(split.join(by_text, ["digest", "text"]).select("digest", "doc_id", "keep_id", "group_size"))
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    kept = dedup(spark, docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_kept_id"), "text_sha256").distinct()
    digest = F.sha2(F.coalesce(docs[text_col], F.lit("")).cast("binary"), 256)
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept_id"]) & (digest == kept["text_sha256"]), "left_semi").dropDuplicates([id_col, text_col])


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
