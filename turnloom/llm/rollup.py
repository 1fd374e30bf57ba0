"""Token counts kept up to date by signed deltas.

A batch of changes is reduced to one signed sum for each (source, lang, tokenizer) and added to the
totals: the new totals are written beside the old ones and count from the moment that a pointer
file, whose creation only one writer can win, names them together with the batches they cover. So
a batch is in the totals whole or not at all, one that comes again changes nothing, and reading
the totals costs as much as there are groups, however many batches there were.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.common import staged
from turnloom.sources.snapshots import Pointers

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


class TokenRollup:
    """Additive totals under ``path`` in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.pointers = spark, path.rstrip("/"), Pointers(spark, path)

    def _state(self) -> dict:
        held = self.pointers.newest()
        return json.loads(held) if held else {"total": None, "before": None, "batches": []}

    def applied(self, batch_id: str) -> bool:
        return batch_id in self._state()["batches"]

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit ``changes`` as ``batch_id``; False, and no change, if it was committed before.

        Columns: op (insert, delete or revise), source, lang, tokenizer, tokens, and old_tokens,
        which only a revision reads. A null source or language is a group of its own, null
        tokens count as 0, and a row with another op, or none, raises. An empty batch commits.
        If another writer commits meanwhile, the deltas are added to what that one left.
        """
        if self.applied(batch_id):
            return False
        op, tokens = F.col("op"), F.coalesce(F.col("tokens"), F.lit(0)).cast("long")
        old = F.coalesce(F.col("old_tokens"), F.lit(0)).cast("long")
        docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0)
        signed = F.when(op == "insert", tokens).when(op == "delete", -tokens).when(op == "revise", tokens - old)
        wrong = F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce(op, F.lit("null"))))
        delta = self._summed(changes.select(*KEYS, F.coalesce(docs, wrong.cast("int")).alias("n_docs"), signed.alias("n_tokens")))
        folder = f"{self.path}/delta-{uuid.uuid4().hex}"
        delta = staged(delta, "delta", folder)
        try:
            while True:
                seen, state = self.pointers.taken(), self._state()
                if batch_id in state["batches"]:  # the same batch by another writer, who was first
                    return False
                made = f"{self.path}/total-{uuid.uuid4().hex}"
                totals = self._summed(self._read(state["total"]).unionByName(delta)).where("n_docs <> 0 or n_tokens <> 0")
                totals.write.parquet(made)
                try:
                    self.pointers.point(json.dumps({"total": made, "before": state["total"], "batches": [*state["batches"], batch_id]}), seen)
                except RuntimeError:  # another batch was first
                    self._drop(made)
                    continue
                self._drop(state["before"])  # readers of the last totals may still be at work
                return True
        finally:
            self._drop(folder)

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").cast("long").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))

    def _read(self, folder: str | None) -> DataFrame:
        return self.spark.read.schema(DELTA).parquet(folder) if folder else self.spark.createDataFrame([], DELTA)

    def _drop(self, folder: str | None) -> None:
        if folder:
            context = self.spark.sparkContext
            target = context._jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; groups that deletes have emptied are gone.
        Before the first batch there is none."""
        return self._read(self._state()["total"])
