"""A maintained inverted index over the texts of many scopes (a scope is a user's store).

The index is a list of immutable segments, one for each batch of changes. A segment holds

* ``postings``: field, bucket, scope, doc, length, term, tf of the texts it brought,
* ``docs``: field, bucket, scope, doc, length, also of texts without any term,
* ``gone``: scope and doc of what it deleted or replaced in older segments,
* ``terms`` and ``sums``: signed changes of the number of texts with a term, and of the number
  and total length of a scope's texts. Their sums over the segments are the running statistics.

Postings lie in a folder for each field and bucket of scopes, so a question reads the buckets of its
own user. When a level has ``fanout`` segments they are merged to one of the next level: texts that
are gone, their tombstones if nothing older is left, and statistics of zero fall away. What counts
is named by one pointer file, so a batch is there whole or not at all, and one that comes again
changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators import ranking
from turnloom.sources.files import _fs
from turnloom.sources.snapshots import Pointers

#: Folders that are named one by one in a read; beyond, the folders above are read and pruned.
FOLDERS = 256
#: Scopes of a set of questions that are also pushed down to the files as a filter.
SCOPES = 200

KINDS = ("postings", "docs", "gone", "terms", "sums")


class Field(NamedTuple):
    """How a text becomes terms, repeats included, and the least length a text counts with."""

    terms: Callable[[Column], Column]
    least: int = 0


class PostingIndex:
    """An index at ``path`` over rows (``scope``, ``doc``, text), whose scope and doc are longs."""

    def __init__(self, spark: SparkSession, path: str, fields: dict[str, Field], scope: str = "user_id", doc: str = "id", buckets: int = 64, fanout: int = 8):
        self.spark, self.path, self.fields = spark, path.rstrip("/"), fields
        self.scope, self.doc, self.fanout = scope, doc, fanout
        self.pointers = Pointers(spark, path)
        held = self.pointers.newest()
        self.state = json.loads(held) if held else {"buckets": buckets, "next": 1, "segments": [], "retired": []}

    # --- changes -------------------------------------------------------------------------

    def apply(self, batch: str, inserts: DataFrame, deletes: DataFrame | None = None, text: str = "content") -> bool:
        """Delete, then insert; whether the batch was new.

        A text of a scope and doc that is there already is replaced. Of several in one batch the
        greatest stays. Deleting what isn't there does nothing. A null text has no terms.
        """
        if any(batch in s["batches"] for s in self.state["segments"]):
            return False
        seen = self.pointers.taken()
        key = [F.col(self.scope).cast("long").alias("scope"), F.col(self.doc).cast("long").alias("doc")]
        rows = inserts.select(*key, F.col(text).alias("text")).groupBy("scope", "doc").agg(F.max("text").alias("text"))
        name = f"{self.state['next']:08d}-{uuid.uuid4().hex[:12]}"
        each = [F.struct(F.lit(f).alias("field"), F.coalesce(x.terms(F.col("text")), F.array()).alias("terms"), F.lit(x.least).alias("least")) for f, x in self.fields.items()]
        rows = rows.select("scope", "doc", self._bucket(), F.explode(F.array(*each)).alias("f")).select("scope", "doc", "bucket", "f.*")
        rows = rows.withColumn("length", F.greatest(F.size("terms"), F.col("least")).cast("long"))
        docs = self._write(rows.select("field", "bucket", "scope", "doc", "length"), "docs", name, ["field"])
        post = rows.select("field", "bucket", "scope", "doc", "length", F.explode("terms").alias("term"))
        post = post.groupBy("field", "bucket", "scope", "doc", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
        post = self._write(post, "postings", name, ["field", "bucket"])
        changed = docs.select("scope", "doc")
        if deletes is not None:
            changed = changed.unionByName(deletes.select(*key))
        gone = None
        if self.state["segments"]:
            changed = changed.distinct()
            old_docs = self._live("docs").join(changed, ["scope", "doc"], "left_semi")
            gone = self._write(old_docs.select("bucket", "scope", "doc").distinct(), "gone", name)
            old = self._live("postings").join(gone.select("scope", "doc"), ["scope", "doc"], "left_semi")
        signed = lambda df, n: df.withColumn("sign", F.lit(n))
        terms, sums = signed(post, 1), signed(docs, 1)
        if gone is not None:
            terms = terms.unionByName(signed(old.select(*post.columns), -1))
            sums = sums.unionByName(signed(old_docs.select(*docs.columns), -1))
        terms = terms.groupBy("field", "bucket", "scope", "term").agg(F.sum("sign").alias("df")).where("df <> 0")
        sums = sums.groupBy("field", "bucket", "scope").agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("length")).alias("length"))
        self._write(terms, "terms", name, ["field", "bucket"])
        self._write(sums, "sums", name, ["field"])
        made = {"name": name, "seq": self.state["next"], "level": 0, "batches": [batch], "gone": gone.count() if gone is not None else 0}
        self._publish([*self.state["segments"], self._folders(made)], [], seen)
        self._merge_full_levels()
        return True

    def _merge_full_levels(self) -> None:
        levels: dict[int, list] = {}
        for s in self.state["segments"]:
            levels.setdefault(s["level"], []).append(s)
        for level in sorted(levels):
            if len(levels[level]) >= self.fanout:
                return self.merge(levels[level])

    def merge(self, parts: list | None = None) -> None:
        """Make one segment of ``parts``, neighbours in age, or of all."""
        parts, seen = parts or self.state["segments"], self.pointers.taken()
        if len(parts) < 2:
            return
        oldest = parts[0] is self.state["segments"][0]
        top = max(parts, key=lambda s: s["seq"])
        name = f"{top['seq']:08d}-{uuid.uuid4().hex[:12]}"
        self._write(self._live("docs", parts).drop("seq"), "docs", name, ["field"])
        self._write(self._live("postings", parts).drop("seq"), "postings", name, ["field", "bucket"])
        n = 0
        if not oldest and any(s["gone"] for s in parts):
            n = self._write(self._read("gone", parts).drop("seq").distinct(), "gone", name).count()
        for kind, by, what in (("terms", ["field", "bucket", "scope", "term"], ["df"]), ("sums", ["field", "bucket", "scope"], ["n", "length"])):
            rows = self._read(kind, parts).groupBy(*by).agg(*(F.sum(x).alias(x) for x in what)).where(f"{what[0]} <> 0")
            self._write(rows, kind, name, ["field", "bucket"] if kind == "terms" else ["field"])
        made = {"name": name, "seq": top["seq"], "level": max(s["level"] for s in parts) + 1, "batches": [b for s in parts for b in s["batches"]], "gone": n}
        names = {s["name"] for s in parts}
        at = self.state["segments"].index(parts[0])
        kept = [s for s in self.state["segments"] if s["name"] not in names]
        self._publish([*kept[:at], self._folders(made), *kept[at:]], sorted(names), seen)

    def _publish(self, segments: list, retired: list, seen: list) -> None:
        """Point at ``segments``; what the publication before this one retired is deleted, so a reader
        has until the next but one to finish."""
        old = self.state["retired"]
        state = {"buckets": self.state["buckets"], "next": max(s["seq"] for s in segments) + 1, "segments": segments, "retired": retired}
        self.pointers.point(json.dumps(state), seen)
        self.state = state
        for name in old:
            for kind in KINDS:
                fs, target = _fs(self.spark, f"{self.path}/{kind}/seg={name}")
                fs.delete(target, True)

    def _write(self, rows: DataFrame, kind: str, name: str, by: list[str] | None = None) -> DataFrame:
        path = f"{self.path}/{kind}/seg={name}"
        rows = rows.hint("rebalance", *by) if by else rows
        order = [x for x in (*(by or []), "scope", "term") if x in rows.columns]
        writer = rows.sortWithinPartitions(*order).write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path).select(*rows.columns)

    def _folders(self, made: dict) -> dict:
        """``made`` with the buckets that each field's postings and terms have."""
        for kind in ("postings", "terms"):
            made[kind] = {}
            for field in self.fields:
                fs, root = _fs(self.spark, f"{self.path}/{kind}/seg={made['name']}/field={field}")
                names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
                made[kind][field] = sorted(int(x.partition("=")[2]) for x in names if x.startswith("bucket="))
        return made

    # --- reading -------------------------------------------------------------------------

    _SCHEMAS = {
        "postings": "scope long, doc long, length long, term string, tf long, seg string, field string, bucket int",
        "docs": "bucket int, scope long, doc long, length long, seg string, field string",
        "gone": "bucket int, scope long, doc long, seg string",
        "terms": "scope long, term string, df long, seg string, field string, bucket int",
        "sums": "bucket int, scope long, n long, length long, seg string, field string",
    }

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("scope"), F.lit(self.state["buckets"])).cast("int").alias("bucket")

    def _read(self, kind: str, parts: list | None = None, field: str | None = None, buckets: set | None = None) -> DataFrame:
        parts = self.state["segments"] if parts is None else parts
        if kind == "gone":
            parts = [s for s in parts if s["gone"]]
        roots = [f"{self.path}/{kind}/seg={s['name']}" for s in parts]
        if kind in ("postings", "terms") and field is not None:
            own = [(s, b) for s in parts for b in s[kind][field] if buckets is None or b in buckets]
            if buckets is not None and len(own) <= FOLDERS:
                roots = [f"{self.path}/{kind}/seg={s['name']}/field={field}/bucket={b}" for s, b in own]
            else:
                roots = [f"{self.path}/{kind}/seg={s['name']}/field={field}" for s in parts if s[kind][field]]
        schema = self._SCHEMAS[kind]
        if not roots:
            rows = self.spark.createDataFrame([], schema)
        else:
            rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*roots)
        if field is not None:
            rows = rows.where(F.col("field") == field)
        if buckets is not None and len(buckets) < self.state["buckets"]:
            rows = rows.where(F.col("bucket").isin(sorted(buckets)))
        return rows.withColumn("seq", F.substring("seg", 1, 8).cast("int")).drop("seg")

    def _standing(self, rows: DataFrame, parts: list | None = None, buckets: set | None = None) -> DataFrame:
        """``rows`` (scope, doc, seq) without those that a later segment deleted."""
        if not any(s["gone"] for s in (self.state["segments"] if parts is None else parts)):
            return rows
        gone = self._read("gone", parts, buckets=buckets).select(F.col("scope").alias("s"), F.col("doc").alias("d"), F.col("seq").alias("at"))
        return rows.join(gone, (F.col("scope") == F.col("s")) & (F.col("doc") == F.col("d")) & (F.col("at") > F.col("seq")), "left_anti")

    def _live(self, kind: str, parts: list | None = None) -> DataFrame:
        return self._standing(self._read(kind, parts), parts)

    def _few(self, asked: DataFrame) -> list | None:
        """The scopes of ``asked`` and their buckets if it has few rows; then no shuffle is needed."""
        rows = asked.select(F.col(self.scope).cast("long").alias("scope")).select("scope", self._bucket()).limit(SCOPES + 1).collect()
        return None if len(rows) > SCOPES else sorted({(x.scope, x.bucket) for x in rows if x.scope is not None})

    def _asked(self, asked: DataFrame) -> tuple[set | None, Callable[[DataFrame], DataFrame]]:
        """The buckets of the scopes of ``asked``, and a filter on these scopes if they are few."""
        few = self._few(asked)
        if few is not None:
            scopes = [x for x, _ in few]
            return {b for _, b in few}, lambda df: df.where(F.col("scope").isin(scopes) if scopes else F.lit(False))
        rows = asked.select(F.col(self.scope).cast("long").alias("scope"))
        # at most one row for each bucket
        return {x.bucket for x in rows.select(self._bucket()).distinct().collect()}, lambda df: df

    def own(self, asked: DataFrame, rows: DataFrame) -> DataFrame:
        """The ``rows`` of the scopes of ``asked``: by a filter that reaches the files if these are few."""
        few = self._few(asked)
        if few is not None:
            return rows.where(F.col(self.scope).isin([x for x, _ in few]) if few else F.lit(False))
        return rows.join(asked.select(self.scope).distinct(), self.scope, "left_semi")

    def scores(self, field: str, asked: DataFrame, query: str, k1: float = 1.5, b: float = 0.75, idf_floor: float | None = None) -> DataFrame:
        """query, doc, score (unrounded) of every pair that shares a term, as ``ranking.bm25`` gives
        them for the texts that stand; ``asked`` has query, scope and terms."""
        buckets, own = self._asked(asked)
        totals = own(self._read("sums", None, field, buckets)).groupBy("scope").agg(F.sum("n").alias("n"), F.sum("length").alias("length"))
        totals = totals.where("n > 0").select("scope", "n", (F.col("length") / F.col("n")).alias("mean"))
        words = ranking.postings(asked.select(query, F.col(self.scope).cast("long").alias("scope"), "terms"), [query, "scope"], "terms").withColumnRenamed("tf", "qtf")
        terms = own(self._read("terms", None, field, buckets)).select("scope", "term", "df")
        met = words.join(terms, ["scope", "term"]).groupBy(query, "scope", "term", "qtf").agg(F.sum("df").alias("df")).where("df > 0")
        found = own(self._read("postings", None, field, buckets)).select("scope", "doc", F.col("length").alias("dl"), "term", "tf", "seq")
        found = self._standing(found.join(ranking.weights(met, totals, "scope", idf_floor), ["scope", "term"]), None, buckets)
        return found.groupBy(query, F.col("doc").alias(self.doc)).agg(F.sum(ranking.part(k1, b)).alias("score"))

    def with_all(self, field: str, asked: DataFrame, query: str) -> DataFrame:
        """query, doc of the texts that have every term of the query."""
        buckets, own = self._asked(asked)
        words = asked.select(query, F.col(self.scope).cast("long").alias("scope"), F.size("terms").alias("m"), F.explode("terms").alias("term"))
        found = own(self._read("postings", None, field, buckets)).select("scope", "doc", "term", "seq").join(words, ["scope", "term"])
        found = self._standing(found, None, buckets).groupBy(query, F.col("doc").alias(self.doc), "m").agg(F.count(F.lit(1)).alias("c"))
        return found.where("c = m").select(query, self.doc)

    def rows(self) -> DataFrame:
        """scope, doc of the texts that stand."""
        first = next(iter(self.fields))
        live = self._standing(self._read("docs", None, first))
        return live.select(F.col("scope").alias(self.scope), F.col("doc").alias(self.doc))
