"""Views of the turns that are kept up with every batch: claims, timeline, conflicts, supersessions.

A batch's claims are compared with the stored ones of the same sessions and with themselves (new x
stored, new x new); what was compared before isn't compared again, and pairs have no order, so any
split of the turns into batches leaves the same views. ``operators.similar`` compares the sets of a
session where they lie together: ``prefixes`` has each claim's whole set, as hashes, and what a pair
says of it, so no candidate pairs are shuffled and no text is read again.

Tables are folders, one for each batch, parted by buckets of users, so a batch reads the buckets of
its own users. A batch counts once the pointer names it; one that comes again changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import dates, text
from turnloom.operators import similar, store
from turnloom.sources.files import _fs
from turnloom.sources.shared import Scratch
from turnloom.sources.snapshots import Pointers

#: Claims of a turn, characters of a claim and of a topic, and the overlap from which
#: claims contradict each other when no model scores them.
CLAIMS, CLAIM_CUT, TOPIC_CUT = 6, 580, 80
CONFLICT = 0.4
#: An overlap of this much stands in for a model's verdict that a claim updates another.
UPDATE = 0.7

VIEWS = ("claims", "prefixes", "timeline", "conflicts", "supersessions")
_SCHEMAS = {
    "claims": "user_id long, session_id long, id long, arrival long, claim long, text string, ts double, valid_from double, source_position long",
    "prefixes": "user_id long, session_id long, id long, ts double, valid_from double, topic string, hashes array<long>",
    "timeline": "user_id long, node_id long, t_sort double, t_label string, entity string, t_kind string",
    "conflicts": "user_id long, a_id long, b_id long, topic string, overlap double",
    "supersessions": "user_id long, older long, newer long, closed_at double, writer long, score double",
}


def claims(turns: DataFrame, once: bool = False) -> DataFrame:
    """The claims of turns (user_id, session_id, arrival, position, said_at, body): their first
    sentences that could be claims, dated by a relative phrase of their own or by their turn.
    ``id`` is arrival * 8 + claim, unique as a turn has at most six. With ``once`` a turn that is
    repeated counts once; only what was found in it crosses the network for that, not its body."""
    found = F.slice(F.filter(text.sentences(F.coalesce("body", F.lit(""))), text.is_claim), 1, CLAIMS)
    rows = turns.select("user_id", "session_id", "arrival", "position", "said_at", text.first_entity(F.col("body")).alias("entity"), found.alias("found"))
    rows = rows.dropDuplicates(["user_id", "arrival"]) if once else rows
    rows = rows.select("user_id", "session_id", "arrival", "position", "said_at", "entity", F.posexplode("found").alias("k", "s"))
    rel = F.when(F.col("said_at").isNotNull(), dates.parse_relative(F.col("s"), F.col("said_at")))
    rows = rows.withColumns({"claim": (F.col("k") + 1).cast("long"), "text": F.left("s", F.lit(CLAIM_CUT)), "own": rel["epoch"].cast("double"), "said": F.col("said_at").cast("double")})
    ts = F.col("arrival").cast("double") + 1_700_000_000
    return rows.select(
        F.col("user_id").cast("long"), F.col("session_id").cast("long"), (F.col("arrival") * 8 + F.col("claim")).alias("id"), F.col("arrival").cast("long"),
        "claim", "text", ts.alias("ts"), F.coalesce("own", "said", ts).alias("valid_from"), F.col("position").cast("long").alias("source_position"),
        F.when(F.col("own").isNotNull(), "relative").when(F.col("said").isNotNull(), "absolute").otherwise("ordinal").alias("t_kind"),
        F.coalesce("own", "said", F.col("position").cast("double")).alias("t_sort"), "entity",
    )


def timeline(rows: DataFrame) -> DataFrame:
    """The events of ``claims``."""
    day = F.date_format(F.timestamp_seconds("t_sort"), "yyyy-MM-dd")
    label = F.when(F.col("t_kind") == "ordinal", F.concat(F.lit("position="), F.col("source_position").cast("string"))).otherwise(day)
    return rows.select("user_id", F.col("id").alias("node_id"), "t_sort", label.alias("t_label"), "entity", "t_kind")


def keys(rows: DataFrame) -> DataFrame:
    """What ``claims`` are compared by, and what a pair says of them: a conflict is on the new claim's
    first name or its first characters. Claims without tokens meet none."""
    hashes = F.transform(similar.token_set(F.col("text")), lambda t: F.xxhash64(t))
    topic = F.coalesce("entity", F.left("text", F.lit(TOPIC_CUT)))
    return rows.select("user_id", "session_id", "id", "ts", "valid_from", topic.alias("topic"), hashes.alias("hashes")).where(F.size("hashes") > 0)


def related(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conflicts and supersessions of ``similar.met`` claims of one session.

    Of a pair the one written later (the larger id) is the new one. Enough of an overlap
    supersedes, by event time where both have one of their own; less contradicts. Both leave a
    conflict, on the new claim's topic.
    """
    late = F.col("x") > F.col("y")
    side = lambda p, one, two: {f"{p}{c}": F.when(late, F.col(f"{one}{k}")).otherwise(F.col(f"{two}{k}")) for c, k in (("", ""), ("_ts", "_ts"), ("_from", "_valid_from"), ("_topic", "_topic"))}
    rows = met.withColumns(side("a", "x", "y") | side("b", "y", "x")).withColumn("overlap", F.col("both") / F.col("either")).where(F.col("overlap") >= CONFLICT)
    update, score = F.col("overlap") >= UPDATE, F.round("overlap", 6)
    rows = store.superseded(rows, "user_id", "a", "b", F.col("a_topic").alias("topic"), "overlap")
    known = rows.select("user_id", F.when(update, F.col("newer")).otherwise(F.col("a")).alias("a_id"), F.when(update, F.col("older")).otherwise(F.col("b")).alias("b_id"), "topic", score.alias("overlap"))
    closed = rows.where(update).select("user_id", "older", "newer", "closed_at", F.col("a").alias("writer"), score.alias("score"))
    return known, closed


class DerivedViews:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.pointers = spark, path.rstrip("/"), Pointers(spark, path)
        held = self.pointers.newest()
        self.state = json.loads(held) if held else {"buckets": buckets, "folders": [], "batches": []}

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col("user_id").cast("long")), F.lit(self.state["buckets"])).cast("int")

    def _write(self, rows: DataFrame, view: str, folder: str) -> DataFrame:
        path = f"{self.path}/{view}/batch={folder}"
        rows = rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path).drop("bucket")

    def read(self, view: str, buckets: list[int] | None = None, folders: list[str] | None = None) -> DataFrame:
        """A view whole, or the users of some buckets, or what some batches brought."""
        folders = self.state["folders"] if folders is None else folders
        if not folders:
            return self.spark.createDataFrame([], _SCHEMAS[view])
        rows = self.spark.read.schema(f"{_SCHEMAS[view]}, bucket int").option("basePath", f"{self.path}/{view}")
        rows = rows.parquet(*[f"{self.path}/{view}/batch={x}" for x in folders])
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        return rows.select(*[x.split()[0] for x in _SCHEMAS[view].split(", ")])

    def changes(self, batch: str) -> dict[str, DataFrame]:
        """What a batch added to each view; empty once it is compacted into others."""
        own = [x for x in self.state["folders"] if x.startswith(f"{batch}-")]
        return {view: self.read(view, folders=own) for view in VIEWS if view != "prefixes"}

    def current(self) -> DataFrame:
        """The claims with valid_to: when the first claim written that supersedes it closed it."""
        first = self.read("supersessions").groupBy("user_id", F.col("older").alias("id")).agg(F.min_by("closed_at", F.struct("writer", "newer")).alias("valid_to"))
        return self.read("claims").join(first, ["user_id", "id"], "left")

    def apply(self, batch: str, turns: DataFrame) -> bool:
        """Take the turns of a batch in; whether it was new. A turn belongs to one batch; turns
        repeated within it count once, those without a body make no claims."""
        if batch in self.state["batches"]:
            return False
        seen, folder = self.pointers.taken(), f"{batch}-{uuid.uuid4().hex[:12]}"
        new = self._write(claims(turns, once=True), "claims", folder)
        self._write(timeline(new), "timeline", folder)
        # one small row for each bucket
        buckets = sorted(x.b for x in new.select(self._bucket().alias("b")).distinct().collect())
        fresh = self._write(keys(new), "prefixes", folder)
        with Scratch(self.spark) as scratch:
            met = similar.met(fresh, self.read("prefixes", buckets), CONFLICT, ["user_id", "session_id"], {"ts": "double", "valid_from": "double", "topic": "string"})
            known, closed = related(scratch.cut(met))
            self._write(known, "conflicts", folder)
            self._write(closed, "supersessions", folder)
        self._publish({"folders": [*self.state["folders"], folder], "batches": [*self.state["batches"], batch]}, seen)
        return True

    def compact(self) -> None:
        """Bring all batches into one folder for each view."""
        seen, old = self.pointers.taken(), self.state["folders"]
        folder = f"compacted-{uuid.uuid4().hex[:12]}"
        for view in VIEWS:
            self._write(self.read(view), view, folder)
        self._publish({"folders": [folder]}, seen)
        for gone in (f"{self.path}/{view}/batch={x}" for view in VIEWS for x in old):
            fs, target = _fs(self.spark, gone)
            fs.delete(target, True)

    def _publish(self, changed: dict, seen: list) -> None:
        state = self.state | changed
        self.pointers.point(json.dumps(state), seen)
        self.state = state
