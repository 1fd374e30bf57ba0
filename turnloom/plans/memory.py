"""Queries of the store's reads and writes and of the evaluation operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnloom.functions import text as fn
from turnloom.operators import evals, recall, similar, store
from turnloom.plans import views as v
from turnloom.plans.catalog import query
from turnloom.plans.text import s_query_tokens, s_sentences, s_tokens
from turnloom.sources import transcripts


@query("get_node", v.sql("SELECT id, content FROM nodes WHERE id % 100 = 1", "nodes"))
def get_node(spark, sf_dir):
    """Point lookups by id; the plan pushes the predicate below the projection."""
    return v.nodes(spark, sf_dir).where("id % 100 = 1").select("id", "content")


@query("recent_turns", v.sql("SELECT user_id, id, rank FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id) AS rank FROM nodes WHERE valid_to IS NULL) WHERE rank <= 20", "nodes"))
def recent_turns(spark, sf_dir):
    """The 20 newest current nodes of every user."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "id"))
    rows = v.nodes(spark, sf_dir).where("valid_to IS NULL").withColumn("rank", rank.cast("long"))
    return rows.where("rank <= 20").select("user_id", "id", "rank")


@query("all_except", v.sql("SELECT id FROM nodes WHERE id <> 101 ORDER BY ts DESC, id LIMIT 50", "nodes"))
def all_except(spark, sf_dir):
    return v.nodes(spark, sf_dir).where("id <> 101").orderBy(F.desc("ts"), "id").limit(50).select("id")


@query("all_nodes", v.sql("SELECT id, tier FROM nodes ORDER BY ts DESC, id LIMIT 5000", "nodes"))
def all_nodes(spark, sf_dir):
    return v.nodes(spark, sf_dir).orderBy(F.desc("ts"), "id").limit(5000).select("id", "tier")


@query("all_edges", v.sql("SELECT src, dst, kind, score FROM edges ORDER BY score DESC, src, dst, kind LIMIT 20000", "edges"))
def all_edges(spark, sf_dir):
    return v.edges(spark, sf_dir).orderBy(F.desc("score"), "src", "dst", "kind").limit(20000).select("src", "dst", "kind", "score")


@query("store_counts", v.sql("SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges", "nodes", "edges"))
def store_counts(spark, sf_dir):
    n = v.nodes(spark, sf_dir).agg(F.count(F.lit(1)).alias("nodes"))
    return n.crossJoin(v.edges(spark, sf_dir).agg(F.count(F.lit(1)).alias("edges")))  # one row each


@query("nodes_with_embeddings", "SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id DESC LIMIT 5000")
def nodes_with_embeddings(spark, sf_dir):
    return v.table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").orderBy(F.desc("vec_id")).limit(5000).select("vec_id")


@query("event_time", v.sql("SELECT id, CASE WHEN abs(valid_from - ts) > 1.0 THEN valid_from END AS event_time FROM nodes", "nodes"))
def event_time(spark, sf_dir):
    n = v.nodes(spark, sf_dir)
    return n.select("id", store.event_time(n).alias("event_time"))


@query("session_turns", v.sql("SELECT session_id, position, min(arrival) AS arrival FROM turns GROUP BY ALL", "turns"))
def session_turns(spark, sf_dir):
    return v.turns(spark, sf_dir).groupBy("session_id", "position").agg(F.min("arrival").alias("arrival"))


_ORDER = """SELECT user_id, session_id, first_said, row_number() OVER (PARTITION BY user_id ORDER BY first_said IS NULL, coalesce(first_said, 0), arrived) AS session_rank
FROM (SELECT user_id, session_id, arg_min(said_at, position) FILTER (WHERE said_at IS NOT NULL) AS first_said, min(arrival) AS arrived FROM turns GROUP BY ALL)"""


@query("sessions_in_time_order", v.sql(_ORDER, "turns"))
def sessions_in_time_order(spark, sf_dir):
    return recall.session_order(v.turns(spark, sf_dir)).drop("arrived")


@query("session_corpus", v.sql("SELECT session_id, string_agg(turn_text, chr(10) ORDER BY position) AS content FROM turns GROUP BY session_id", "turns"))
def session_corpus(spark, sf_dir):
    return recall.joined(v.turns(spark, sf_dir), ["session_id"], ["position"], "turn_text")


@query(
    "source_sessions",
    v.sql("SELECT session_id::VARCHAR AS sample_id, 1 AS session_index, position, role, role || ': ' || body AS content, (1704067200 + session_id * 60) * 1000 AS timestamp_ms FROM turns", "turns"),
)
def source_sessions(spark, sf_dir):
    """Conversations as nested transcripts, read back as messages."""
    none = F.lit(None).cast("string")
    message = F.struct("position", F.struct(F.col("role").alias("speaker"), F.col("body").alias("text"), F.lit(None).cast("array<string>").alias("images"), none.alias("blip_caption"), none.alias("query")).alias("m"))
    own = F.transform(F.array_sort(F.collect_list(message)), lambda x: x["m"])
    talks = v.turns(spark, sf_dir).groupBy("session_id").agg(own.alias("messages"))
    said = F.lower(F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("session_id") * 60), "h:mm a"))
    day = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("session_id") * 60), "d MMMM, yyyy")
    session = F.struct(F.lit(1).alias("session_index"), F.concat(said, F.lit(" on "), day).alias("date_time"), "messages")
    rows = talks.select(F.col("session_id").cast("string").alias("sample_id"), F.lit("user").alias("speaker_a"), F.lit("assistant").alias("speaker_b"), F.array(session).alias("sessions"))
    return transcripts.messages(rows)


@query("session_positions", v.sql("SELECT arrival, session_id % 5 + row_number() OVER (PARTITION BY session_id ORDER BY arrival) - 1 AS position FROM turns", "turns"))
def session_positions(spark, sf_dir):
    """New messages go on from where their session stood before."""
    t = v.turns(spark, sf_dir).select("user_id", "session_id", "arrival", F.col("arrival").alias("ord"))
    known = t.select("user_id", "session_id").distinct().withColumn("next_position", F.col("session_id") % 5)
    return store.positions(t, known).select("arrival", "position")


@query(
    "add_nodes",
    v.sql("SELECT sha256(user_id || '|' || session_id || '|' || position) AS id, coalesce(said_at, 1700000000 + arrival)::DOUBLE AS valid_from, CASE WHEN length(turn_text) > 600 THEN 'episodic' ELSE 'fact' END AS tier FROM turns", "turns"),
)
def add_nodes(spark, sf_dir):
    ts = (F.lit(1700000000) + F.col("arrival")).cast("double")
    rows = v.turns(spark, sf_dir).select(
        "user_id", "session_id", "position", F.col("turn_text").alias("content"), ts.alias("ts"), F.col("said_at").cast("double").alias("valid_from"), F.lit(None).cast("string").alias("tier")
    )
    return store.new_nodes(rows).select("id", "valid_from", "tier")


@query("tier_auto", v.sql("SELECT tier, count(*) AS n FROM nodes GROUP BY tier", "nodes"))
def tier_auto(spark, sf_dir):
    return v.nodes(spark, sf_dir).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("upsert_edges", v.sql("SELECT src, dst, kind, max(score) AS score FROM (SELECT src, dst, kind, score FROM edges UNION ALL SELECT src, dst, kind, round(score + 1, 6) FROM edges WHERE src % 3 = 0) GROUP BY ALL", "edges"))
def upsert_edges(spark, sf_dir):
    """A second write of a third of the links replaces the first."""
    e = v.edges(spark, sf_dir).withColumn("written", F.lit(1))
    again = e.where("src % 3 = 0").withColumns({"score": F.round(F.col("score") + 1, 6), "written": F.lit(2)})
    kept = store.latest(e.unionByName(again), ["src", "dst", "kind"], F.desc("written"))
    return kept.select("src", "dst", store.checked_kind(F.col("kind")).alias("kind"), "score")


@query("timeline_events", v.sql("SELECT node_id, t_sort, t_label, t_kind FROM timeline", "timeline"))
def timeline_events(spark, sf_dir):
    return store.latest(v.timeline(spark, sf_dir), ["node_id"], F.desc("t_sort")).select("node_id", "t_sort", "t_label", "t_kind")


@query("conflict_edges", v.sql("SELECT user_id, a_id AS src, b_id AS dst, 'conflicts_with' AS kind, 1.0::DOUBLE AS score FROM conflicts UNION ALL SELECT user_id, b_id, a_id, 'conflicts_with', 1.0::DOUBLE FROM conflicts", "conflicts"))
def conflict_edges(spark, sf_dir):
    return store.conflict_edges(v.conflicts(spark, sf_dir))


_PROFILE = "SELECT user_id AS scope_key, right(string_agg(left(body, 400), chr(10) ORDER BY arrival), 800) AS content FROM turns WHERE contains(lower(body), 'th') GROUP BY user_id"


@query("profile_build", v.sql(_PROFILE, "turns"))
def profile_build(spark, sf_dir):
    t = v.turns(spark, sf_dir).where(F.contains(F.lower("body"), F.lit("th")))
    return store.profiles(t.select(F.col("user_id").alias("scope_key"), F.col("arrival").alias("ord"), F.left("body", F.lit(400)).alias("line")))


@query("profiles_upsert", v.sql("SELECT user_id AS scope_key, left(arg_max(body, arrival), 800) AS content FROM turns GROUP BY user_id", "turns"))
def profiles_upsert(spark, sf_dir):
    rows = v.turns(spark, sf_dir).groupBy(F.col("user_id").alias("scope_key")).agg(F.max_by("body", "arrival").alias("content"))
    return rows.withColumn("content", F.left("content", F.lit(store.PROFILE_CHARS)))


@query("invalidate", v.sql("SELECT id, coalesce(valid_to, CASE WHEN id % 3 = 0 THEN ts + 5 END) AS valid_to FROM nodes", "nodes"))
def invalidate(spark, sf_dir):
    n = v.nodes(spark, sf_dir)
    return store.invalidated(n, n.where("id % 3 = 0").select("id", (F.col("ts") + 5).alias("at"))).select("id", "valid_to")


_SUP = """SELECT CASE WHEN older THEN a_id ELSE b_id END AS older, CASE WHEN older THEN b_id ELSE a_id END AS newer, CASE WHEN older THEN bf ELSE af END AS closed_at
FROM (SELECT a_id, b_id, a.valid_from AS af, b.valid_from AS bf, abs(a.valid_from - a.ts) > 1 AND abs(b.valid_from - b.ts) > 1 AND a.valid_from < b.valid_from AS older
  FROM conflicts JOIN nodes a ON a.id = a_id JOIN nodes b ON b.id = b_id)"""


@query("supersede", v.sql(_SUP, "conflicts", "nodes"))
def supersede(spark, sf_dir):
    n = v.nodes(spark, sf_dir)
    side = lambda p: n.select(F.col("id").alias(f"{p}_id"), F.col("ts").alias(f"{p}_ts"), F.col("valid_from").alias(f"{p}_from"))
    rows = v.conflicts(spark, sf_dir).select("a_id", "b_id").join(side("a"), "a_id").join(side("b"), "b_id")
    return store.superseded(rows.withColumnsRenamed({"a_id": "a", "b_id": "b"}))


_IDEM = """SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN session_id % 3 = 0 THEN 'new' WHEN session_id % 3 = 1 THEN 'duplicate' ELSE 'conflict' END AS outcome
FROM (SELECT DISTINCT session_id FROM turns)) GROUP BY outcome"""


@query("add_idempotency", v.sql(_IDEM, "turns"))
def add_idempotency(spark, sf_dir):
    """Every session as a request against receipts of two thirds of them, half with another digest."""
    digest = F.sha2(F.concat_ws("|", F.array_sort(F.collect_list("turn_text"))), 256)
    requests = v.turns(spark, sf_dir).groupBy("user_id", F.col("session_id").alias("request_id")).agg(digest.alias("digest"))
    old = requests.where("request_id % 3 <> 0")
    receipts = old.withColumn("digest", F.when(F.col("request_id") % 3 == 1, F.col("digest")).otherwise(F.sha2("digest", 256)))
    return store.add_outcome(requests, receipts).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("current_only", v.sql("SELECT user_id, count(*) AS n FROM nodes WHERE valid_to IS NULL GROUP BY user_id", "nodes"))
def current_only(spark, sf_dir):
    return v.nodes(spark, sf_dir).where("valid_to IS NULL").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


_PREFIX = """SELECT id, concat_ws(', ', 'source=' || id, 'position=' || source_position, 'speaker=' || source_role, CASE WHEN valid_to IS NOT NULL THEN 'superseded' END,
  'date=' || strftime(to_timestamp(CASE WHEN abs(valid_from - ts) > 1 THEN valid_from END)::TIMESTAMP, '%Y-%m-%d'), 'session=' || scope_session, CASE WHEN tier <> 'fact' THEN 'tier=' || tier END) AS prefix FROM nodes"""


@query("evidence_prefix", v.sql(_PREFIX, "nodes"))
def evidence_prefix(spark, sf_dir):
    n = v.nodes(spark, sf_dir)
    return n.select("id", store.evidence_prefix(n).alias("prefix"))


_NEAR = """SELECT src, dst, kind, rank FROM (SELECT e.src, e.dst, e.kind, row_number() OVER (PARTITION BY e.src ORDER BY e.score DESC, e.dst, e.kind) AS rank
FROM edges e JOIN nodes n ON n.id = e.dst) WHERE rank <= 5"""


@query("neighbors", v.sql(_NEAR, "edges", "nodes"))
def neighbors(spark, sf_dir):
    n = v.nodes(spark, sf_dir)
    return store.neighbours(n.select(F.col("id").alias("src")), v.edges(spark, sf_dir), n, 5).select("src", "dst", "kind", "rank")


@query("supersede_neighbors", v.sql("SELECT e.src, e.dst FROM edges e JOIN nodes n ON n.id = e.dst WHERE kind = 'supersedes'", "edges", "nodes"))
def supersede_neighbors(spark, sf_dir):
    n = v.nodes(spark, sf_dir)
    return store.neighbours(n.select(F.col("id").alias("src")), v.edges(spark, sf_dir), n, 5, "supersedes").select("src", "dst")


_HOP = """SELECT query_id, dst AS node_id FROM (SELECT q.query_id, e.dst, row_number() OVER (PARTITION BY q.query_id ORDER BY e.score DESC, e.dst, e.kind) AS rank
FROM queries q JOIN edges e ON e.src = q.query_id JOIN nodes n ON n.id = e.dst) WHERE rank <= 5 GROUP BY ALL"""


@query("one_hop_expand", v.sql(_HOP, "queries", "edges", "nodes"))
def one_hop_expand(spark, sf_dir):
    """Five neighbours of every query's own turn, new ones only."""
    seeds = v.queries(spark, sf_dir).select(F.col("query_id").alias("src"))
    rows = store.neighbours(seeds, v.edges(spark, sf_dir), v.nodes(spark, sf_dir), 5)
    found = rows.select(F.col("src").alias("query_id"), F.col("dst").alias("node_id")).distinct()
    return found.join(seeds.select(F.col("src").alias("query_id"), F.col("src").alias("node_id")), ["query_id", "node_id"], "left_anti")


@query("timeline_for_nodes", v.sql("SELECT node_id, t_sort, t_label, t_kind FROM timeline WHERE node_id % 2 = 0", "timeline"))
def timeline_for_nodes(spark, sf_dir):
    t = v.timeline(spark, sf_dir)
    return store.earliest_events(t, t.where("node_id % 2 = 0").select("node_id"))


_CONF = """SELECT x, y, EXISTS (SELECT 1 FROM conflicts c WHERE (c.a_id = x AND c.b_id = y) OR (c.a_id = y AND c.b_id = x)) AS is_conflict
FROM (SELECT dst AS x, src AS y FROM edges WHERE kind = 'semantic')"""


@query("are_conflicting", v.sql(_CONF, "edges", "conflicts"))
def are_conflicting(spark, sf_dir):
    pairs = v.edges(spark, sf_dir).where("kind = 'semantic'").select(F.col("dst").alias("x"), F.col("src").alias("y"))
    return store.conflicting(pairs, v.conflicts(spark, sf_dir))


def matching_conflicts(queries, conflicts, nodes):
    """query_id, id, a_id, b_id, topic, a_content, b_content: conflicts of a query's user whose topic has one of its
    tokens, or of whose bodies one has the query or one of its words of over three letters. All that match are kept.
    """
    side = lambda p: nodes.select(F.col("id").alias(f"{p}_id"), F.col("content").alias(f"{p}_content"))
    known = conflicts.join(side("a"), "a_id").join(side("b"), "b_id")
    text = F.regexp_replace(F.lower("query"), r"(?U)^\s+|\s+$", "")
    q = queries.select("query_id", "user_id", fn.query_tokens(F.col("query")).alias("t"), text.alias("q"))
    q = q.withColumn("words", F.filter(F.split("q", r"(?U)\s+"), lambda w: F.length(w) > 3))
    topic, both = F.lower(F.coalesce("topic", F.lit(""))), F.lower(F.concat_ws(" ", "a_content", "b_content"))
    has = F.exists("t", lambda t: F.contains(topic, t)) | F.contains(topic, F.col("q"))
    has |= F.contains(both, F.col("q")) | F.exists("words", lambda w: F.contains(both, w))
    return q.join(known, "user_id").where(has).select("query_id", "id", "a_id", "b_id", "topic", "a_content", "b_content")


_SRCH = f"""SELECT query_id, id, a_id, b_id, topic, a_content, b_content FROM (
  SELECT q.query_id, c.id, c.a_id, c.b_id, c.topic, a.content AS a_content, b.content AS b_content, {s_query_tokens('q.query')} AS t,
    regexp_replace(lower(q.query), '^\\s+|\\s+$', '', 'g') AS q, lower(a.content || ' ' || b.content) AS inter
  FROM queries q JOIN conflicts c USING (user_id) JOIN nodes a ON a.id = c.a_id JOIN nodes b ON b.id = c.b_id)
WHERE len(list_filter(t, lambda x: contains(topic, x))) > 0 OR contains(topic, q) OR contains(inter, q)
  OR len(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: length(w) > 3 AND contains(inter, w))) > 0"""


@query("search_conflicts_whole", v.sql(_SRCH, "queries", "conflicts", "nodes"))
@query("search_conflicts", v.sql(_SRCH, "queries", "conflicts", "nodes"))
def search_conflicts(spark, sf_dir):
    """Conflicts of a query's user by topic or by either body, with both nodes."""
    return matching_conflicts(v.queries(spark, sf_dir), v.conflicts(spark, sf_dir), v.nodes(spark, sf_dir))


_FINDP = f"""SELECT query_id, scope_key, len(list_filter(t, lambda x: contains(lower(content), x))) AS hits
FROM (SELECT q.query_id, p.scope_key, p.content, {s_query_tokens('q.query')} AS t FROM queries q JOIN ({_PROFILE}) p ON p.scope_key = q.user_id)
WHERE len(list_filter(t, lambda x: contains(lower(content), x))) > 0"""


@query("find_profiles", v.sql(_FINDP, "queries"))
def find_profiles(spark, sf_dir):
    q = v.queries(spark, sf_dir).select("query_id", F.col("user_id").alias("scope_key"), fn.query_tokens(F.col("query")).alias("t"))
    low = F.lower("content")
    hits = F.size(F.filter("t", lambda t: F.contains(low, t))).cast("long")
    return q.join(profile_build(spark, sf_dir), "scope_key").select("query_id", "scope_key", hits.alias("hits")).where("hits > 0")


@query("source_turn", v.sql("SELECT n.id, coalesce(e.dst, n.id) AS source FROM nodes n LEFT JOIN (SELECT src, min(dst) AS dst FROM edges WHERE kind = 'temporal' GROUP BY src) e ON e.src = n.id", "nodes", "edges"))
def source_turn(spark, sf_dir):
    link = v.edges(spark, sf_dir).where("kind = 'temporal'").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("dst"))
    return v.nodes(spark, sf_dir).select("id").join(link, "id", "left").select("id", F.coalesce("dst", "id").alias("source"))


_SETS = """sets AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+'), lambda w: length(w) > 2))) AS w FROM documents WHERE text IS NOT NULL),
stands AS (SELECT min(doc_id) AS id, w, len(w) AS n FROM sets WHERE len(w) > 0 GROUP BY w),
toks AS (SELECT id, n, unnest(w) AS t FROM stands),
met AS (SELECT x.id AS x, y.id AS y, any_value(x.n) + any_value(y.n) - count(*) AS either, count(*) AS inter FROM toks x JOIN toks y ON x.t = y.t AND x.id < y.id GROUP BY x.id, y.id)
"""
_JAC = f"WITH {_SETS} SELECT x, y, round(inter / either::DOUBLE, 6) AS overlap FROM met WHERE inter * 4 >= either"


def _overlaps(spark, sf_dir, threshold):
    """Pairs of documents by the overlap of their tokens, each a stored text; equal ones count once."""
    d = v.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    rows = d.select(F.lit(0).alias("scope"), F.col("doc_id").alias("id"), similar.token_set(F.col("text")).alias("tokens"))
    return similar.similar(rows, threshold).drop("scope")


@query("token_overlap_pairs", _JAC)
def token_overlap_pairs(spark, sf_dir):
    return _overlaps(spark, sf_dir, 0.25)


@query("token_overlap_classes", f"WITH {_SETS} SELECT doc_id, min(doc_id) OVER (PARTITION BY w) AS class_id FROM sets WHERE len(w) > 0")
def token_overlap_classes(spark, sf_dir):
    """The document that stands for each one's equal token sets in the pairs."""
    d = v.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    rows = d.select(F.lit(0).alias("scope"), F.col("doc_id").alias("id"), similar.token_set(F.col("text")).alias("tokens"))
    return similar.classes(rows).select(F.col("id").alias("doc_id"), "class_id")


@query("conflict_candidates", f"SELECT x, y, CASE WHEN overlap >= 0.4 THEN 'conflict' ELSE 'candidate' END AS kind FROM ({_JAC})")
def conflict_candidates(spark, sf_dir):
    return _overlaps(spark, sf_dir, 0.25).select("x", "y", F.when(F.col("overlap") >= 0.4, "conflict").otherwise("candidate").alias("kind"))


@query("write_relations", f"SELECT x, y, CASE WHEN overlap >= 0.7 THEN 'supersedes' WHEN overlap >= 0.6 THEN 'semantic' END AS kind FROM ({_JAC}) WHERE overlap >= 0.6")
def write_relations(spark, sf_dir):
    """The links a write makes at given relation scores; the overlap stands in for the scorer."""
    kind = F.when(F.col("overlap") >= 0.7, "supersedes").otherwise("semantic")
    return _overlaps(spark, sf_dir, 0.6).where("overlap >= 0.6").select("x", "y", kind.alias("kind"))


@query("claim_timeline", v.sql(f"SELECT arrival, k AS claim, coalesce(said_at, position)::DOUBLE AS t_sort, CASE WHEN said_at IS NULL THEN 'ordinal' ELSE 'absolute' END AS t_kind FROM (SELECT arrival, said_at, position, unnest(range(1, 1 + least(6, len(list_filter({s_sentences('body')}, lambda s: length(s) >= 20 AND len(list_filter(TRIG, lambda w: contains(lower(s), w))) > 0))))) AS k FROM turns)".replace("TRIG", "[" + ", ".join(f"'{w}'" for w in fn.CLAIM_TRIGGERS) + "]"), "turns"))
def claim_timeline(spark, sf_dir):
    """A claim's event: the date in the claim, else its session's, else its turn's position."""
    from turnloom.functions import dates

    t = v.turns(spark, sf_dir)
    found = F.slice(F.filter(fn.sentences(F.col("body")), fn.is_claim), 1, 6)
    rows = t.select("arrival", "said_at", "position", F.posexplode(found).alias("k", "s"))
    own = F.when(F.col("said_at").isNotNull(), dates.parse_relative(F.col("s"), F.col("said_at"))["epoch"])
    rows = rows.withColumn("own", own)
    kind = F.when(F.col("own").isNotNull(), "relative").when(F.col("said_at").isNull(), "ordinal").otherwise("absolute")
    return rows.select("arrival", (F.col("k") + 1).cast("long").alias("claim"), F.coalesce("own", F.col("said_at").cast("double"), F.col("position").cast("double")).alias("t_sort"), kind.alias("t_kind"))


@query("prepare_rows", v.sql("SELECT q.query_id, q.query, count(*) AS turns FROM queries q JOIN turns t ON t.session_id = q.query_id // 100 GROUP BY ALL", "queries", "turns"))
def prepare_rows(spark, sf_dir):
    """Questions with the size of their conversation."""
    t = v.turns(spark, sf_dir).groupBy(F.col("session_id").alias("sid")).agg(F.count(F.lit(1)).alias("turns"))
    return v.queries(spark, sf_dir).join(t, F.expr("query_id div 100") == F.col("sid")).select("query_id", "query", "turns")


_COV = """SELECT qa_id, 'unknown' AS problem FROM p ANTI JOIN documents d ON d.doc_id = p.qa_id
UNION ALL SELECT qa_id, 'duplicate' FROM p GROUP BY qa_id HAVING count(*) > 1
UNION ALL SELECT doc_id, 'missing' FROM documents WHERE doc_id NOT IN (SELECT qa_id FROM p)"""


@query("coverage_check", "WITH p AS (SELECT doc_id AS qa_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 10 = 0 UNION ALL SELECT -doc_id - 1 FROM labels WHERE doc_id % 50 = 0)\n" + _COV)
def coverage_check(spark, sf_dir):
    """Labels as predictions, some twice and some unknown, against all documents."""
    own = v.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("qa_id"))
    unknown = own.where("qa_id % 50 = 0").select((-F.col("qa_id") - 1).alias("qa_id"))
    made = own.unionByName(own.where("qa_id % 10 = 0")).unionByName(unknown)
    return evals.coverage(made, v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qa_id")))


@query("selected_evidence", v.sql("SELECT session_id, list_position([3, 1, 2], session_id % 4) AS ord, count(*) AS turns FROM turns WHERE session_id % 4 IN (1, 2, 3) GROUP BY session_id", "turns"))
def selected_evidence(spark, sf_dir):
    """Sessions named by an ordered list, in its order."""
    wanted = F.array_position(F.array(F.lit(3), F.lit(1), F.lit(2)), (F.col("session_id") % 4).cast("int"))
    rows = v.turns(spark, sf_dir).where("session_id % 4 IN (1, 2, 3)")
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns")).withColumn("ord", wanted.cast("long"))


@query("paired_outcomes", v.sql("SELECT count(*) FILTER (a = 1 AND b = 1) AS \"both\", count(*) FILTER (a = 1 AND b = 0) AS only_a, count(*) FILTER (a = 0 AND b = 1) AS only_b, count(*) FILTER (a = 0 AND b = 0) AS neither FROM outcomes", "outcomes"))
def paired_outcomes(spark, sf_dir):
    return evals.paired(v.outcomes(spark, sf_dir))


@query("category_counts", v.sql("SELECT category, count(*) AS n FROM outcomes GROUP BY category", "outcomes"))
def category_counts(spark, sf_dir):
    return v.outcomes(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("accuracy_overall", v.sql("SELECT count(a) AS n, sum(a)::BIGINT AS correct, round(avg(a), 6) AS accuracy FROM outcomes", "outcomes"))
def accuracy_overall(spark, sf_dir):
    return evals.accuracy(v.outcomes(spark, sf_dir))


@query("accuracy_breakdown", v.sql("SELECT category, cluster, count(a) AS n, sum(a)::BIGINT AS correct, round(avg(a), 6) AS accuracy FROM outcomes GROUP BY ALL", "outcomes"))
def accuracy_breakdown(spark, sf_dir):
    return evals.accuracy(v.outcomes(spark, sf_dir), "category", "cluster")


@query("cluster_bootstrap")
def cluster_bootstrap(spark, sf_dir):
    return evals.cluster_bootstrap(v.outcomes(spark, sf_dir))


_BIN = """SELECT bin, count(*) AS n FROM (SELECT CASE WHEN n = hits THEN 'all' WHEN hits > 0 THEN 'some' ELSE 'none' END AS bin
FROM (SELECT b.item_id, count(*) AS n, count(*) FILTER (contains(regexp_replace(lower(b.text), '\\s+', ' ', 'g'), w)) AS hits
  FROM benchmark b, (SELECT DISTINCT lower(o_orderpriority[3:]) AS w FROM orders UNION SELECT 'the' UNION SELECT 'and') GROUP BY b.item_id)) GROUP BY bin"""


@query("coverage_bins", _BIN)
def coverage_bins(spark, sf_dir):
    """How many annotated spans each item's normalised text has: all, some or none."""
    spans = v.table(spark, sf_dir, "orders").select(F.lower(F.substr("o_orderpriority", F.lit(3))).alias("w"))
    words = spans.unionByName(spark.createDataFrame([("the",), ("and",)], "w string")).distinct().agg(F.collect_set("w").alias("ws"))
    text = F.regexp_replace(F.lower("text"), r"\s+", " ")
    rows = v.table(spark, sf_dir, "benchmark").crossJoin(F.broadcast(words))  # one row of five priorities and two words
    hits, n = F.size(F.filter("ws", lambda w: F.contains(text, w))), F.size("ws")
    return rows.select(F.when(hits == n, "all").when(hits > 0, "some").otherwise("none").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("token_stats", v.sql(f"SELECT min(t) AS lo, max(t) AS hi, round(avg(t), 6) AS mean, median(t)::DOUBLE AS mid FROM (SELECT {s_tokens('turn_text')} AS t FROM turns)", "turns"))
def token_stats(spark, sf_dir):
    t = v.turns(spark, sf_dir).select(fn.estimate_tokens(F.col("turn_text")).alias("t"))
    return t.agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.round(F.avg("t"), 6).alias("mean"), F.median("t").alias("mid"))


@query("activity_recent", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def activity_recent(spark, sf_dir):
    return v.table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "event_type")


@query("prove_gate", v.sql("SELECT id, least(9.0::DOUBLE, greatest(0.0::DOUBLE, s)) >= 4.0 + CASE WHEN gaps THEN 1 ELSE 0 END AS proves FROM (SELECT id, (id % 13)::DOUBLE AS s, id % 2 = 0 AS gaps FROM nodes)", "nodes"))
def prove_gate(spark, sf_dir):
    """Given scores against the floor of 4, one more if the contract left gaps; clamped to 0..9."""
    score = F.least(F.lit(9.0), F.greatest(F.lit(0.0), (F.col("id") % 13).cast("double")))
    return v.nodes(spark, sf_dir).select("id", (score >= 4.0 + (F.col("id") % 2 == 0).cast("int")).alias("proves"))


@query("usefulness_sort", v.sql("SELECT user_id, id, rank FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY least(10, greatest(0, coalesce(s, 0))) DESC, id) AS rank FROM (SELECT user_id, id, CASE WHEN id % 5 > 0 THEN id % 17 - 2 END AS s FROM nodes)) WHERE rank <= 8", "nodes"))
def usefulness_sort(spark, sf_dir):
    """The eight most useful nodes of every user by a given score, unscored at 0, clamped to 0..10."""
    s = F.when(F.col("id") % 5 > 0, F.col("id") % 17 - 2)
    score = F.least(F.lit(10), F.greatest(F.lit(0), F.coalesce(s, F.lit(0))))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("s"), "id")).cast("long")
    return v.nodes(spark, sf_dir).withColumn("s", score).withColumn("rank", rank).where("rank <= 8").select("user_id", "id", "rank")


@query("scope_boost", v.sql("SELECT query_id, id, rank FROM (SELECT q.query_id, n.id, row_number() OVER (PARTITION BY q.query_id ORDER BY CASE WHEN n.scope_session = q.query_id // 100 THEN 5 ELSE 0 END DESC, coalesce(valid_from, ts) DESC, n.id) AS rank FROM queries q JOIN nodes n ON n.user_id = q.user_id) WHERE rank <= 12", "queries", "nodes"))
def scope_boost(spark, sf_dir):
    """A query's own session first, then the newest; twelve of its user's nodes."""
    rows = v.queries(spark, sf_dir).join(v.nodes(spark, sf_dir), "user_id")
    boost = F.when(F.col("scope_session") == F.expr("query_id div 100"), 5).otherwise(0)
    w = Window.partitionBy("query_id").orderBy(boost.desc(), F.coalesce("valid_from", "ts").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 12").select("query_id", "id", "rank")
