"""Queries of a store's upkeep: migration, vectors, resumed runs, gates, capped evidence, real dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions import dates, text
from turnloom.operators import evals, recall, store
from turnloom.plans import views as v
from turnloom.plans.catalog import query
from turnloom.plans.dates import _ABS
from turnloom.plans.text import _CLAIMS, s_tokens
from turnloom.sources.shared import shared_dir
from turnloom.streaming import derived


@query("migrated_nodes", v.sql("SELECT id, content, ts, NULL::VARCHAR AS tier, NULL::BIGINT AS source_position FROM nodes", "nodes"))
def migrated_nodes(spark, sf_dir):
    """Nodes of a store that had no tiers and positions yet, under today's schema."""
    old = v.nodes(spark, sf_dir).select("id", "content", F.col("ts").cast("float").cast("double").alias("ts"), F.lit("gone").alias("dropped"))
    old = old.withColumn("ts", (F.lit(1700000000) + F.col("id")).cast("double"))
    return store.migrated(old, "id long, content string, ts double, tier string, source_position long")


@query("set_embeddings", v.sql("SELECT n.id, len(e.embedding)::BIGINT AS dims FROM nodes n LEFT JOIN embeddings e ON e.vec_id = n.id", "nodes"))
def set_embeddings(spark, sf_dir):
    e = v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    rows = store.with_embeddings(v.nodes(spark, sf_dir), e)
    return rows.select("id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long").alias("dims"))


@query("normal_claims", v.sql("SELECT arrival, trim(regexp_replace(replace(replace(lower(body), 'ß', 'ss'), 'ς', 'σ'), '\\s+', ' ', 'g')) AS claim FROM turns", "turns"))
def normal_claims(spark, sf_dir):
    return v.turns(spark, sf_dir).select("arrival", text.normal_claim(F.col("body")).alias("claim"))


@query("role_session_turns", v.sql("SELECT q.query_id, n.id FROM queries q JOIN nodes n ON n.user_id = q.user_id AND n.scope_session = q.query_id // 100 WHERE lower(n.source_role) = 'user'", "queries", "nodes"))
def role_session_turns(spark, sf_dir):
    """The user's own turns of each query's session."""
    q = v.queries(spark, sf_dir).select("query_id", "user_id", F.expr("query_id div 100").alias("scope_session"))
    n = v.nodes(spark, sf_dir).where("lower(source_role) = 'user'").select("user_id", "scope_session", "id")
    return q.join(n, ["user_id", "scope_session"]).select("query_id", "id")


@query("pending_answers", "SELECT doc_id AS qa_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_answers(spark, sf_dir):
    """What a resumed run has still to answer."""
    asked = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qa_id"))
    return evals.pending(asked, v.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("qa_id")))


@query("resumed_answers", "SELECT doc_id AS qa_id, 'first' AS answer FROM labels UNION ALL SELECT doc_id, 'second' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resumed_answers(spark, sf_dir):
    """Answers after a second run over everything: a completed one is never replaced."""
    done = v.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("qa_id"), F.lit("first").alias("answer"))
    return evals.resumed(done, v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qa_id"), F.lit("second").alias("answer")))


_GATE = """SELECT category, n, correct, passes FROM (SELECT category, count(*) AS n, sum(a)::BIGINT AS correct, 100 * abs(sum(a) - sum(b)) <= count(*) AND sum(a) >= sum(b) AS passes FROM outcomes GROUP BY category)"""


@query("accuracy_gate", v.sql(_GATE, "outcomes"))
def accuracy_gate(spark, sf_dir):
    """Each category's count of a against that of b: at least as many, and within a point of it."""
    o = v.outcomes(spark, sf_dir)
    counts = o.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("correct"), F.sum("b").alias("original"))
    return counts.select("category", "n", "correct", evals.gate(F.col("correct"), F.col("original"), F.col("original"), F.col("n")).alias("passes"))


@query("options_appended", v.sql("SELECT query_id, CASE WHEN query_id % 200 = 0 THEN query || chr(10) || 'Options:' || chr(10) || string_split(query, ' ')[1] || chr(10) || string_split(query, ' ')[-1] ELSE query END AS asked FROM queries", "queries"))
def options_appended(spark, sf_dir):
    """Queries with the options to choose from, where there are any."""
    w = F.split("query", " ")
    options = F.when(F.col("query_id") % 200 == 0, F.array(w[0], F.element_at(w, -1)))
    return v.queries(spark, sf_dir).select("query_id", text.with_options(F.col("query"), options).alias("asked"))


_CAP = f"""SELECT arrival, capped, capped <> turn_text AS cut FROM (SELECT arrival, turn_text, CASE WHEN {s_tokens('turn_text')} <= 20 THEN turn_text ELSE
  left(turn_text, length(array_to_string(p[1:19], '')) + length(array_to_string(g[1:20], ''))) END AS capped
FROM (SELECT arrival, turn_text, regexp_extract_all(turn_text, PIECE) AS p, string_split_regex(turn_text, PIECE) AS g FROM turns))""".replace(
    "PIECE", s_tokens("x").partition("(x, ")[2].rpartition(")))")[0]
)


@query("cap_evidence_tokens", v.sql(_CAP, "turns"))
def cap_evidence_tokens(spark, sf_dir):
    """The longest prefix of every turn within 20 estimated tokens, and whether anything was cut."""
    capped = recall.capped(F.col("turn_text"), 20)
    return v.turns(spark, sf_dir).select("arrival", capped.alias("capped"), (capped != F.col("turn_text")).alias("cut"))


@query("parse_absolute_documents", _ABS.replace("note_id", "doc_id").replace("FROM notes", "FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)"))
def parse_absolute_documents(spark, sf_dir):
    """The first absolute date of every whole document."""
    body = F.coalesce("text", F.lit(""))
    return v.table(spark, sf_dir, "documents").select("doc_id", dates.parse_absolute(body)["epoch"].alias("epoch"))


def _maintained(spark, sf_dir, path, batches=3):
    """The derived views of all documents, brought in by several batches, the second of them twice."""
    made, turns = derived.DerivedViews(spark, path), v.entries(spark, sf_dir)
    for n in (*range(batches), 1):
        made.apply(f"batch-{n}", turns.where(F.pmod(F.xxhash64("arrival"), F.lit(batches)) == n))
    return made


_CLAIMED = _CLAIMS.replace("FROM turns", "FROM entries")


@query("maintained_claims", v.sql(_CLAIMED, "entries"))
def maintained_claims(spark, sf_dir):
    """The claims of all documents, kept up batch by batch."""
    made = _maintained(spark, sf_dir, shared_dir(spark, "views"))
    return made.read("claims").select("arrival", "claim", "text")


_KEPT = f"""claims AS ({_CLAIMED}),
words AS (SELECT session_id, arrival * 8 + claim AS id, list_distinct(list_filter(regexp_split_to_array(lower(c.text), '[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+'), lambda w: length(w) > 2)) AS w FROM claims c JOIN entries USING (arrival)),
toks AS (SELECT session_id, id, len(w) AS n, unnest(w) AS t FROM words),
met AS (SELECT x.id AS lo, y.id AS hi, count(*) AS inter, any_value(x.n) + any_value(y.n) - count(*) AS either
  FROM toks x JOIN toks y ON x.session_id = y.session_id AND x.t = y.t AND x.id < y.id GROUP BY x.id, y.id)
SELECT lo, hi, round(inter / either::DOUBLE, 6) AS overlap, inter * 10 >= either * 7 AS updates FROM met WHERE inter * 10 >= either * 4"""


@query("maintained_conflicts", v.sql(_KEPT, "entries"))
def maintained_conflicts(spark, sf_dir):
    """The conflicts among all claims, kept up batch by batch, and whether one updates the other."""
    made = _maintained(spark, sf_dir, shared_dir(spark, "views"))
    closed = made.read("supersessions").select(F.least("older", "newer").alias("lo"), F.greatest("older", "newer").alias("hi"), F.lit(True).alias("u"))
    rows = made.read("conflicts").select(F.least("a_id", "b_id").alias("lo"), F.greatest("a_id", "b_id").alias("hi"), "overlap")
    return rows.join(closed, ["lo", "hi"], "left").select("lo", "hi", "overlap", F.coalesce("u", F.lit(False)).alias("updates"))
