"""Idempotent, append-only ingestion of messages, in batches or as a stream.

What must be remembered for ever, receipts and the next position of each session, lives in the tables, not in the
state of a stream, so a restart or a repeated batch can't add a request twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.operators import store
from turnloom.sources.files import _fs

REQUEST = "user_id string, request_id string, session_id string, ord long, role string, content string, timestamp_ms long"
RECEIPT = "user_id string, request_id string, digest string"
SESSION = "user_id string, session_id string, next_position long"
TURN = "user_id string, session_id string, position long, role string, content string, said_at double, request_id string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:  # the first batch finds no table
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def digests(messages: DataFrame) -> DataFrame:
    """user_id, request_id, digest of whole requests."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "session_id", "role", "content", "timestamp_ms")))
    return messages.groupBy("user_id", "request_id").agg(F.sha2(F.to_json(rows), 256).alias("digest"))


#: Buckets of users, and batches whose receipts and session ends lie apart before they are folded.
BUCKETS, FOLD = 64, 8


def _bucket():
    return F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).cast("int")


def _kept(spark: SparkSession, path: str, schema: str, buckets: list[int]) -> DataFrame:
    """What a table that is kept by user holds for some buckets: only their folders are read."""
    rows = _read(spark, path, f"{schema}, epoch string, part string, bucket int")
    return rows.where(F.col("bucket").isin(buckets)).drop("part", "bucket")


def _keep(rows: DataFrame, path: str, part: str) -> None:
    rows = rows.withColumn("bucket", _bucket()).hint("rebalance", "bucket")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/part={part}")


def _mark(path: str, part: str) -> str:
    return f"{path}/folded/{part.removeprefix('part=')}"


def fold(spark: SparkSession, path: str, current: int | str) -> None:
    """Bring the receipts and session ends of all batches but the current one into one part.

    Written first, then every batch is marked as folded, then its own parts go: a crash in between
    leaves rows twice, which changes nothing, as receipts are distinct and the largest end counts.
    """
    for table, schema in (("receipts", RECEIPT), ("sessions", SESSION)):
        root = f"{path}/{table}"
        fs, folder = _fs(spark, root)
        parts = sorted(x.getPath().getName() for x in fs.listStatus(folder) if x.getPath().getName().startswith("part="))
        old = [x for x in parts if x != f"part={current}"]
        if table == "sessions":  # a batch is whole once its receipts are there, and those are folded first
            old = [x for x in old if x.startswith("part=folded-") or fs.exists(_fs(spark, _mark(path, x))[1])]
        if len(old) <= FOLD:
            continue
        rows = spark.read.schema(f"{schema}, epoch string, bucket int").option("basePath", root).parquet(*[f"{root}/{x}" for x in old])
        if table == "sessions":
            rows = rows.groupBy("user_id", "session_id").agg(F.max("next_position").alias("next_position"), F.max("epoch").alias("epoch"))
        else:
            rows = rows.drop("bucket").dropDuplicates(["user_id", "request_id"])
        _keep(rows, root, f"folded-{uuid.uuid4().hex}")
        for x in old:
            if table == "receipts":
                fs.mkdirs(_fs(spark, _mark(path, x))[1])
            fs.delete(_fs(spark, f"{root}/{x}")[1], True)


def add(spark: SparkSession, path: str, messages: DataFrame, epoch: int | str) -> DataFrame:
    """Add the new requests of ``messages``; user_id, request_id, outcome of all of them.

    A request seen before is a duplicate if its payload is the same, else a conflict; neither
    changes anything. Of requests that share an id in one batch with the same user, the payload
    is their union. Positions go on from each session's last. A batch reads the receipts and
    session ends of its own users' buckets, a few parts however many batches there were; one that
    is run again has the same effect, or none once it is folded.
    """
    result = f"{path}/outcomes/{epoch}"
    fs, mark = _fs(spark, f"{path}/folded/{epoch}")
    if fs.exists(mark):
        return spark.read.parquet(result)
    valid = messages.where(F.col("role").isin("user", "assistant") & (F.col("content") != ""))
    buckets = [x.b for x in valid.select(_bucket().alias("b")).distinct().collect()]  # a row for each bucket
    own = F.col("epoch") == F.lit(str(epoch))  # a batch that is run again must not meet itself
    known = _kept(spark, f"{path}/receipts", RECEIPT, buckets).where(~own).drop("epoch").dropDuplicates(["user_id", "request_id"])
    outcome = store.add_outcome(digests(valid), known)
    new = outcome.where("outcome = 'new'")
    last = _kept(spark, f"{path}/sessions", SESSION, buckets).where(~own).drop("epoch")
    last = last.groupBy("user_id", "session_id").agg(F.max("next_position").alias("next_position"))
    fresh = valid.join(new.select("user_id", "request_id"), ["user_id", "request_id"], "left_semi")
    order = F.row_number().over(Window.partitionBy("user_id", "session_id").orderBy("request_id", "ord"))
    placed = store.positions(fresh.withColumn("ord", order), last)
    rows = placed.select("user_id", "session_id", "position", "role", "content", (F.col("timestamp_ms") / 1000).alias("said_at"), "request_id")
    outcome.write.mode("overwrite").parquet(result)
    rows.write.mode("overwrite").parquet(f"{path}/turns/epoch={epoch}")
    added = spark.read.schema(TURN).parquet(f"{path}/turns/epoch={epoch}")
    ends = added.groupBy("user_id", "session_id").agg((F.max("position") + 1).alias("next_position"))
    tag = F.lit(str(epoch)).alias("epoch")
    _keep(ends.select("*", tag), f"{path}/sessions", str(epoch))
    made = spark.read.parquet(result).where("outcome = 'new'").select("user_id", "request_id", "digest", tag)
    _keep(made, f"{path}/receipts", str(epoch))
    fold(spark, path, epoch)
    return spark.read.parquet(result)


def stream(requests: DataFrame, path: str, checkpoint: str):
    """A running query that adds each micro-batch of the streaming frame ``requests``."""

    def batch(messages: DataFrame, epoch: int) -> None:
        add(messages.sparkSession, path, messages, epoch)

    return requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()
