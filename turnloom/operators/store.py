"""The memory store's reads and writes as set operations on its relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How much of a profile is kept, and what kinds an edge may have.
PROFILE_CHARS = 800
EDGE_KINDS = ("semantic", "temporal", "causal", "entity", "supersedes", "conflicts_with")


def event_time(node: DataFrame):
    """valid_from, if it is known and differs from ts by more than a second; else null."""
    return F.when(F.abs(F.col("valid_from") - F.col("ts")) > 1.0, F.col("valid_from"))


def latest(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The last written row of each key, as an upsert leaves it."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def new_nodes(rows: DataFrame) -> DataFrame:
    """Nodes as they are stored: id from user, session and position; an unset valid_from is ts;
    an unknown tier is fact, and an unset one depends on the length."""
    tier = F.when(F.col("tier").isin("fact", "episodic", "claim"), F.col("tier")).when(
        F.col("tier").isNull() & (F.length("content") > 600), "episodic"
    )
    return rows.withColumns(
        {
            "id": F.sha2(F.concat_ws("|", "user_id", "session_id", "position"), 256),
            "valid_from": F.coalesce("valid_from", "ts"),
            "tier": tier.otherwise("fact"),
        }
    )


def migrated(rows: DataFrame, schema: str) -> DataFrame:
    """``rows`` under ``schema``: columns that were added since are null, others are cast, unknown ones go."""
    kept = {c.lower() for c in rows.columns}
    fields = rows.sparkSession.createDataFrame([], schema).schema.fields
    return rows.select(*[(F.col(f.name) if f.name.lower() in kept else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def with_embeddings(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """``nodes`` with ``embedding`` from ``vectors`` (id, embedding and, if they are ordered, ord); where
    they have none, the node's own stays. Of several for one node the last by ord counts, of those
    the greatest."""
    order = F.struct("ord", "embedding") if "ord" in vectors.columns else F.col("embedding")
    new = vectors.where("embedding IS NOT NULL").groupBy("id").agg(F.max_by("embedding", order).alias("new_embedding"))
    own = F.col("embedding") if "embedding" in nodes.columns else F.lit(None)
    return nodes.join(new, "id", "left").withColumn("embedding", F.coalesce("new_embedding", own)).drop("new_embedding")


def checked_kind(kind):
    return F.when(kind.isin(*EDGE_KINDS), kind).otherwise(F.raise_error(F.concat(F.lit("unknown edge kind "), kind)))


def conflict_edges(pairs: DataFrame) -> DataFrame:
    """The two links of each conflicting pair, at score 1."""
    both = F.array(F.struct(F.col("a_id").alias("src"), F.col("b_id").alias("dst")), F.struct(F.col("b_id").alias("src"), F.col("a_id").alias("dst")))
    return pairs.select("user_id", F.explode(both).alias("e")).select(
        "user_id", "e.src", "e.dst", F.lit("conflicts_with").alias("kind"), F.lit(1.0).alias("score")
    )


def invalidated(nodes: DataFrame, closings: DataFrame) -> DataFrame:
    """``nodes`` with valid_to set from ``closings`` (id, at) where it was open; the earliest wins."""
    first = closings.groupBy("id").agg(F.min("at").alias("at"))
    return nodes.join(first, "id", "left").withColumn("valid_to", F.coalesce("valid_to", "at")).drop("at")


def superseded(pairs: DataFrame, *kept) -> DataFrame:
    """older, newer, closed_at of pairs (a, b, a_ts, a_from, b_ts, b_from), after the columns ``kept``; a is
    the one just written.

    Event times decide only if both are explicit; else the written node is the newer.
    """
    explicit = (F.abs(F.col("a_from") - F.col("a_ts")) > 1.0) & (F.abs(F.col("b_from") - F.col("b_ts")) > 1.0)
    a_older = F.coalesce(explicit & (F.col("a_from") < F.col("b_from")), F.lit(False))
    return pairs.select(
        *kept,
        F.when(a_older, F.col("a")).otherwise(F.col("b")).alias("older"),
        F.when(a_older, F.col("b")).otherwise(F.col("a")).alias("newer"),
        F.when(a_older, F.col("b_from")).otherwise(F.col("a_from")).alias("closed_at"),
    )


def add_outcome(requests: DataFrame, receipts: DataFrame) -> DataFrame:
    """``requests`` (user_id, request_id, digest) as new, duplicate or conflict against receipts."""
    known = receipts.select("user_id", "request_id", F.col("digest").alias("known"))
    outcome = F.when(F.col("known").isNull(), "new").when(F.col("known") == F.col("digest"), "duplicate").otherwise("conflict")
    return requests.join(known, ["user_id", "request_id"], "left").withColumn("outcome", outcome).drop("known")


def positions(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """``messages`` (user_id, session_id, ord) with position, going on from each session's next_position."""
    w = Window.partitionBy("user_id", "session_id").orderBy("ord")
    rows = messages.join(sessions, ["user_id", "session_id"], "left")
    place = F.coalesce(F.col("next_position"), F.lit(0)) + F.row_number().over(w) - 1
    return rows.withColumn("position", place.cast("long")).drop("next_position")


def neighbours(frontier: DataFrame, edges: DataFrame, nodes: DataFrame, limit: int, kind: str | None = None) -> DataFrame:
    """src, dst, kind, score, rank: the ``limit`` best links from each ``src`` of ``frontier``."""
    links = edges.where(F.col("kind") == kind) if kind else edges
    rows = links.join(frontier, "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst", "kind"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit)


def earliest_events(timeline: DataFrame, ids: DataFrame) -> DataFrame:
    """The earliest timeline event of each listed node."""
    rows = timeline.join(ids, "node_id", "left_semi")
    e = F.struct("t_sort", "t_label", "t_kind")
    return rows.groupBy("node_id").agg(F.min(e).alias("e")).select("node_id", "e.*")


def conflicting(pairs: DataFrame, conflicts: DataFrame) -> DataFrame:
    """``pairs`` (x, y) with is_conflict, whichever way round a conflict is stored."""
    known = conflicts.select(F.least("a_id", "b_id").alias("lo"), F.greatest("a_id", "b_id").alias("hi"), F.lit(True).alias("hit")).distinct()
    rows = pairs.withColumns({"lo": F.least("x", "y"), "hi": F.greatest("x", "y")})
    return rows.join(known, ["lo", "hi"], "left").select("x", "y", F.coalesce("hit", F.lit(False)).alias("is_conflict"))


def profiles(lines: DataFrame) -> DataFrame:
    """scope_key, content: each scope's lines in order, the last PROFILE_CHARS characters."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("scope_key").agg(F.right(joined, F.lit(PROFILE_CHARS)).alias("content"))


def evidence_prefix(node: DataFrame):
    """ "source=…, position=…, …" of a node, as it stands before its text in a proof or prompt."""
    text = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}="), c.cast("string")))
    when = F.date_format(F.timestamp_seconds(event_time(node)), "yyyy-MM-dd")
    return F.concat_ws(
        ", ",
        text("source", F.col("id")),
        text("position", F.col("source_position")),
        F.when(F.col("source_role") != "", F.concat(F.lit("speaker="), F.col("source_role"))),
        F.when(F.col("valid_to").isNotNull(), F.lit("superseded")),
        text("date", when),
        text("session", F.col("scope_session")),
        F.when(F.col("tier") != "fact", F.concat(F.lit("tier="), F.col("tier"))),
    )
