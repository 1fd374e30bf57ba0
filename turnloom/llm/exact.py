"""Exact dedup as a stateful stream with disk-backed state that never expires.

Documents land as segments of a content log. A Structured Streaming query over the log keeps
one state row for each digest in RocksDB: how many rows had it, and the stable id and the
content locator (file and row of the log) of the row that stays. No watermark is set, so a
digest is never forgotten. Digests that were hit more than once are then checked byte for byte
against the text at the retained locator; texts that differ under one digest are told apart by
the text itself, so a collision cannot merge documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.common import fresh, lower_ascii, shared_dir, staged

#: Segments in which a table is landed: later ones meet the state that earlier ones left.
SEGMENTS = 2

#: State on disk. A run has few batches, so a task closes its store once committed: an open one
#: holds 4 MB of preallocated files beside its rows.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def land(docs: DataFrame, store: str, segment: str) -> None:
    """Write ``docs`` as a segment of the log. Landing a segment again replaces its files, so a
    retry before the stream has read them adds no rows twice."""
    docs.write.mode("overwrite").option("compression", "zstd").parquet(f"{store}/content/segment={segment}")


def _log(reader, store: str, schema) -> DataFrame:
    """Rows of the log with their locators; ``schema`` is that of the documents."""
    log = reader.schema(schema).option("recursiveFileLookup", "true").parquet(f"{store}/content")
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return log.withColumn(fresh(log, "at")[0], F.struct(F.col("doc_id").cast("long").alias("doc_id"), *place))


def _digested(log: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    norm = lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return log.select(norm.alias("norm"), F.col(log.columns[-1]).alias("at")).select(
        digest(F.col("norm")).alias("digest"), "at", "norm"
    )


def advance(
    spark: SparkSession,
    store: str,
    schema,
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int = 4096,
) -> None:
    """Take every segment that is not in the state yet into it, exactly once.

    The state is a streaming aggregation, so each task adds up its own rows of a digest before
    any are shuffled: a digest that a third of the rows share costs one row from each task.
    """
    log = _log(spark.readStream.option("maxFilesPerTrigger", files_per_batch), store, schema)
    state = (
        _digested(log, digest)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max("at").alias("keep"))
    )

    def commit(changed: DataFrame, epoch: int) -> None:
        changed.write.mode("overwrite").option("compression", "zstd").parquet(f"{store}/changes/{epoch:08d}")

    before = {key: spark.conf.get(key, None) for key in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{store}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(commit)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def resolve(spark: SparkSession, store: str, schema, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """at, keep, group_size, digest of every row in the log, after the check of bytes."""
    at = "struct<doc_id: bigint, file: string, row: bigint>"
    changes = (
        spark.read.schema(f"digest string, group_size bigint, keep {at}")
        .option("recursiveFileLookup", "true")
        .parquet(f"{store}/changes")
    )
    # A digest's later changes replace its earlier ones, and its count only grows.
    state = changes.groupBy("digest").agg(F.max("group_size").alias("group_size"), F.max("keep").alias("keep"))
    # Written first: a join of two plain shuffles can be split where one digest has many rows.
    state = staged(state, "exact-state", f"{store}/state")
    log = _digested(_log(spark.read, store, schema), digest)
    rows = log.join(state, "digest").select(
        "digest", "at", "group_size", "keep", F.when(F.col("group_size") > 1, F.col("norm")).alias("norm")
    )
    rows = staged(rows, "exact-rows", f"{store}/rows")
    hits = rows.where("group_size > 1")
    retained = hits.where(F.col("at").eqNullSafe(F.col("keep"))).select(
        "digest", F.col("norm").alias("retained")
    )
    differing = hits.join(retained, "digest").where("norm <> retained").select("digest").distinct()
    out = rows.select("digest", "at", "group_size", "keep")
    if not differing.isEmpty():  # a collision: the texts themselves decide within these digests
        differing = staged(differing, "exact-differing", f"{store}/differing")
        texts = hits.join(differing, "digest", "left_semi")
        groups = texts.groupBy("digest", "norm").agg(
            F.count(F.lit(1)).alias("group_size"), F.max("at").alias("keep")
        )
        told = texts.select("digest", "at", "norm").join(groups, ["digest", "norm"])
        out = out.join(differing, "digest", "left_anti").unionByName(told.drop("norm"))
    return out.select("at", "keep", F.col("group_size").cast("long").alias("group_size"), "digest")


def _taken(docs: DataFrame, store: str, digest: Callable[[Column], Column]) -> None:
    """Land ``docs`` in segments by doc_id and take each into the state before the next lands."""
    for k in range(SEGMENTS):
        land(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SEGMENTS)) == k), store, str(k))
        advance(docs.sparkSession, store, docs.schema, digest)


def dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, digest.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts
    the row with the largest doc_id stays; a null doc_id is smaller than any other, and among
    repeated rows of one doc_id exactly one stays. Columns beside doc_id and text are not read.
    An empty table gives an empty table.
    """
    spark = docs.sparkSession
    store, docs = shared_dir(spark, "exact"), docs.select("doc_id", "text")
    _taken(docs, store, digest)
    return resolve(spark, store, docs.schema, digest).select(
        F.col("at.doc_id").alias("doc_id"),
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        F.col("at").eqNullSafe(F.col("keep")).alias("kept"),
        "digest",
    )


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, whole, with their own columns; ties as in ``dedup``.

    The rows come back from the content log by their locators, so of repeated rows one stays.
    """
    spark = docs.sparkSession
    store = shared_dir(spark, "exact")
    _taken(docs, store, sha256)
    found = resolve(spark, store, docs.schema)
    stay = found.where(F.col("at").eqNullSafe(F.col("keep"))).select("at.file", "at.row")
    log = _log(spark.read, store, docs.schema)
    at = log.columns[-1]
    stay = stay.select(F.struct("file", "row").alias(at + "_kept"))
    same = (F.col(at)["file"] == F.col(at + "_kept")["file"]) & (F.col(at)["row"] == F.col(at + "_kept")["row"])
    return log.join(stay, same, "left_semi").drop(at)
