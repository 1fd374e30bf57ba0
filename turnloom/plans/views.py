"""Relations that the registered queries run on, derived from the driver's tables.

``SQL`` holds the same definitions for DuckDB, so every oracle starts from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bodies of dated notes, in turn by event_id.
PHRASES = (
    "I met Anna yesterday, and the plan was fine.",
    "We moved 3 days ago. The flat is small.",
    "The Garden show was last Friday.",
    "Two months ago we visited Rome and it was hot",
    "The talk was in mid-February, I think.",
    "On 2023-05-08 the contract was signed.",
    "March 3, 2023 was the launch; nobody came.",
    "The date 2023-02-30 is wrong.",
    "I saw the doctor a week ago and last weekend.",
    "See you tomorrow, or next week maybe.",
    "He left 12 April 2022, she left on May 5.",
    "Nothing dated here at all.",
    "In December 2021 we began.",
    "last year and last month were busy, this week is not.",
    "I've been learning piano for about 2 months.",
    "It happened on February 31st, they say.",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User and assistant turns: ten conversations a user, every seventh undated."""
    c = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    said = F.lit(1704067200) + (F.col("conv_id") * 37) % 365 * 86400 + F.col("turn") * 60
    return c.select(
        F.expr("conv_id div 10").alias("user_id"),
        F.col("conv_id").alias("session_id"),
        (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("position"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("arrival"),
        F.when(F.col("conv_id") % 7 != 0, said).alias("said_at"),
        "role",
        F.col("text").alias("body"),
        F.concat_ws(": ", "role", "text").alias("turn_text"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as turns, a hundred ids a user and session; every third undated."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    said = F.when(F.col("doc_id") % 3 != 0, F.lit(1704067200) + (F.col("doc_id") * 37) % 365 * 86400)
    block = F.expr("doc_id div 100")
    return d.select(block.alias("user_id"), block.alias("session_id"), (F.col("doc_id") % 100).alias("position"), F.col("doc_id").alias("arrival"), said.alias("said_at"), F.col("text").alias("body"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn whose id is divisible by 100, as a query of its first six words to its user's turns."""
    words = F.slice(F.split("body", " "), 1, 6)
    return (
        turns(spark, sf_dir)
        .where("arrival % 100 = 0")
        .select(F.col("arrival").alias("query_id"), "user_id", F.array_join(words, " ").alias("query"))
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as store nodes; every fifth position of a session is superseded."""
    ts = (F.lit(1700000000) + F.col("arrival")).cast("double")
    return turns(spark, sf_dir).select(
        "user_id",
        F.col("arrival").alias("id"),
        F.col("turn_text").alias("content"),
        ts.alias("ts"),
        F.when(F.length("turn_text") > 600, "episodic").otherwise("fact").alias("tier"),
        F.col("session_id").alias("scope_session"),
        F.coalesce(F.col("said_at").cast("double"), ts).alias("valid_from"),
        F.when(F.col("position") % 5 == 4, ts + 86400).alias("valid_to"),
        F.col("position").alias("source_position"),
        F.col("role").alias("source_role"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a session: each turn to the next (temporal), to the one after that (semantic), and
    from every fifth back to its first (supersedes)."""
    t = turns(spark, sf_dir)
    w = Window.partitionBy("session_id").orderBy("position")
    size = F.length("body")
    t = t.select(
        "user_id",
        F.col("arrival").alias("src"),
        "position",
        F.lead("arrival").over(w).alias("next"),
        F.lead("arrival", 2).over(w).alias("after"),
        F.first("arrival").over(w).alias("head"),
        F.round(1 / (1 + size % 97), 6).alias("score"),
    )
    made = [
        t.where("next is not null").select("user_id", "src", F.col("next").alias("dst"), F.lit("temporal").alias("kind"), "score"),
        t.where("after is not null").select("user_id", "src", F.col("after").alias("dst"), F.lit("semantic").alias("kind"), "score"),
        t.where("position % 5 = 4").select("user_id", "src", F.col("head").alias("dst"), F.lit("supersedes").alias("kind"), "score"),
    ]
    return made[0].unionByName(made[1]).unionByName(made[2])


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated short notes, one an event."""
    phrases = F.array(*[F.lit(x) for x in PHRASES])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("note_id"),
        F.unix_timestamp("ts").alias("said_at"),
        F.element_at(phrases, (F.col("event_id") % len(PHRASES) + 1).cast("int")).alias("body"),
    )


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timeline events of nodes: every turn at its date or, undated, at its position."""
    return turns(spark, sf_dir).select(
        "user_id",
        F.col("arrival").alias("node_id"),
        F.coalesce(F.col("said_at"), F.col("position")).cast("double").alias("t_sort"),
        F.concat(F.lit("turn="), F.col("position").cast("string")).alias("t_label"),
        F.regexp_extract("body", r"(?<![\p{L}\p{N}_])([A-Z][a-z]+)", 1).alias("entity"),
        F.when(F.col("said_at").isNotNull(), "absolute").otherwise("ordinal").alias("t_kind"),
    )


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a session's positions 0 and 2, on the first word of the first."""
    t = turns(spark, sf_dir)
    a = t.where("position = 0").select("user_id", "session_id", F.col("arrival").alias("a_id"), F.lower(F.element_at(F.split("body", " "), 1)).alias("topic"))
    b = t.where("position = 2").select("session_id", F.col("arrival").alias("b_id"))
    return a.join(b, "session_id").select("user_id", F.col("session_id").alias("id"), "a_id", "b_id", "topic", (F.lit(1700000000) + F.col("session_id")).cast("double").alias("ts"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two 0/1 scores of each labelled document, its language as category and source as cluster."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(
        F.col("doc_id").alias("qa_id"), F.col("lang").alias("category"), F.col("source").alias("cluster"), F.col("quality").cast("long").alias("a"), F.col("toxic").cast("long").alias("b")
    )


_PHRASES_SQL = ", ".join("'" + x.replace("'", "''") + "'" for x in PHRASES)

SQL = {
    "turns": """SELECT conv_id // 10 AS user_id, conv_id AS session_id,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, conv_id * 100 + turn AS arrival,
  CASE WHEN conv_id % 7 <> 0 THEN 1704067200 + (conv_id * 37) % 365 * 86400 + turn * 60 END AS said_at,
  role, text AS body, role || ': ' || text AS turn_text
FROM conversations WHERE role IN ('user', 'assistant')""",
    "entries": """SELECT doc_id // 100 AS user_id, doc_id // 100 AS session_id, doc_id % 100 AS position, doc_id AS arrival, text AS body
FROM documents WHERE text IS NOT NULL""",
    "queries": """SELECT arrival AS query_id, user_id, array_to_string(string_split(body, ' ')[1:6], ' ') AS query
FROM turns WHERE arrival % 100 = 0""",
    "nodes": """SELECT user_id, arrival AS id, turn_text AS content, (1700000000 + arrival)::DOUBLE AS ts,
  CASE WHEN length(turn_text) > 600 THEN 'episodic' ELSE 'fact' END AS tier, session_id AS scope_session,
  coalesce(said_at, 1700000000 + arrival)::DOUBLE AS valid_from,
  CASE WHEN position % 5 = 4 THEN (1700000000 + arrival + 86400)::DOUBLE END AS valid_to,
  position AS source_position, role AS source_role FROM turns""",
    "links": """SELECT user_id, arrival AS src, position, lead(arrival) OVER w AS nxt, lead(arrival, 2) OVER w AS aft,
  first_value(arrival) OVER w AS head, round(1.0::DOUBLE / (1 + length(body) % 97), 6) AS score
FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY position)""",
    "edges": """SELECT user_id, src, nxt AS dst, 'temporal' AS kind, score FROM links WHERE nxt IS NOT NULL
UNION ALL SELECT user_id, src, aft, 'semantic', score FROM links WHERE aft IS NOT NULL
UNION ALL SELECT user_id, src, head, 'supersedes', score FROM links WHERE position % 5 = 4""",
    "notes": f"""SELECT event_id AS note_id, floor(epoch(ts))::BIGINT AS said_at,
  ([{_PHRASES_SQL}])[event_id % {len(PHRASES)} + 1] AS body FROM events""",
    "timeline": """SELECT user_id, arrival AS node_id, coalesce(said_at, position)::DOUBLE AS t_sort,
  'turn=' || position AS t_label, regexp_extract(body, '(?:^|[^\\p{L}\\p{N}_])([A-Z][a-z]+)', 1) AS entity,
  CASE WHEN said_at IS NOT NULL THEN 'absolute' ELSE 'ordinal' END AS t_kind FROM turns""",
    "conflicts": """SELECT a.user_id, a.session_id AS id, a.arrival AS a_id, b.arrival AS b_id,
  lower(string_split(a.body, ' ')[1]) AS topic, (1700000000 + a.session_id)::DOUBLE AS ts
FROM turns a JOIN turns b ON a.session_id = b.session_id AND a.position = 0 AND b.position = 2""",
    "outcomes": """SELECT doc_id AS qa_id, lang AS category, source AS cluster, quality::BIGINT AS a, toxic::BIGINT AS b
FROM labels JOIN documents USING (doc_id)""",
}
_NEEDS = {"queries": ["turns"], "nodes": ["turns"], "links": ["turns"], "edges": ["turns", "links"], "timeline": ["turns"], "conflicts": ["turns"]}


def sql(body: str, *names: str) -> str:
    """``body`` after the definitions of the named relations and of those they need."""
    wanted: list[str] = []
    for name in names:
        wanted += [x for x in [*_NEEDS.get(name, []), name] if x not in wanted]
    ctes = [f"{x} AS ({SQL[x]})" for x in wanted]
    return ("WITH " + ",\n".join(ctes) + ("\n" if body.lstrip().upper().startswith("SELECT") else ",\n") if ctes else "") + body
