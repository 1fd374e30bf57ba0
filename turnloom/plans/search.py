"""Queries of ranked search, recall and packing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnloom.functions import text as fn
from turnloom.operators import ranking, recall
from turnloom.plans import views as v
from turnloom.plans.catalog import query
from turnloom.plans.memory import _ORDER
from turnloom.plans.text import s_fts, s_lexical, s_query_tokens, s_sides, s_stem, s_tokens, s_words
from turnloom.sources.postings import Field, PostingIndex
from turnloom.sources.shared import Scratch, shared_dir, written
from turnloom.streaming import derived


def _placed(spark, sf_dir):
    return recall.placed(v.turns(spark, sf_dir))


_PLACED = f"placed AS (SELECT t.*, o.session_rank, o.first_said, o.session_rank * 1000000 + t.position AS place FROM turns t JOIN ({_ORDER}) o USING (user_id, session_id))"


def _bm25(doc_terms: str, query_terms: str, least: int = 0) -> str:
    """CTEs up to ``scored``: query_id, user_id, arrival, place, score of all of a user's turns."""
    return f"""{_PLACED},
docs AS (SELECT user_id, arrival, place, {doc_terms} AS terms FROM placed),
totals AS (SELECT user_id, count(*) AS n, coalesce(nullif(avg(greatest(len(terms), {least})), 0), 1.0) AS mean FROM docs GROUP BY user_id),
post AS (SELECT user_id, arrival, dl, term, count(*) AS tf FROM (SELECT user_id, arrival, greatest(len(terms), {least}) AS dl, unnest(terms) AS term FROM docs) GROUP BY ALL),
freq AS (SELECT user_id, term, count(*) AS df FROM post GROUP BY ALL),
asked AS (SELECT query_id, user_id, term, count(*) AS qtf FROM (SELECT query_id, user_id, unnest({query_terms}) AS term FROM queries) GROUP BY ALL),
hits AS (SELECT query_id, arrival, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))) AS score
  FROM asked JOIN freq USING (user_id, term) JOIN totals USING (user_id) JOIN post USING (user_id, term) GROUP BY ALL),
scored AS (SELECT q.query_id, q.user_id, p.arrival, p.session_id, p.position, p.place, p.turn_text, p.body, round(coalesce(h.score, 0), 9) AS score
  FROM queries q JOIN placed p USING (user_id) LEFT JOIN hits h ON h.query_id = q.query_id AND h.arrival = p.arrival),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place, arrival) AS rank FROM scored)
"""


_A = _bm25(s_words("turn_text"), s_words("query"))
_B = _bm25(s_lexical("body"), s_lexical("query"), 1)


def _turn_ranks(spark, sf_dir, k=20):
    rows = _placed(spark, sf_dir).withColumn("text", F.col("turn_text"))
    return ranking.ranked_turns(rows, v.queries(spark, sf_dir), fn.stemmed_words, k)


@query("bm25_turn_search", v.sql(_A + "SELECT query_id, arrival, rank, round(score, 6) AS score FROM ranked WHERE rank <= 20", "turns", "queries"))
def bm25_turn_search(spark, sf_dir):
    """The flagship: the 20 best turns of its user's history for every query."""
    return _turn_ranks(spark, sf_dir).select("query_id", "arrival", "rank", F.round("score", 6).alias("score"))


def turn_index(spark, path, turns):
    """An index of the turns' stemmed words at ``path``, brought up in three batches: half of the
    turns, some with a wrong text; the others; the wrong ones deleted and brought again."""
    index = PostingIndex(spark, path, {"stems": Field(fn.stemmed_words)}, doc="arrival")
    rows = turns.select("user_id", "arrival", F.col("turn_text").alias("content"))
    first = F.col("arrival") % 2 == 0
    wrong = first & (F.col("arrival") % 3 == 0)
    index.apply("first", rows.where(first).withColumn("content", F.when(wrong, F.reverse("content")).otherwise(F.col("content"))))
    index.apply("second", rows.where(~first))
    index.apply("mended", rows.where(wrong), rows.where(wrong))
    return index


def indexed_ranks(index, turns, queries, k=20):
    """``ranking.ranked_turns`` by a maintained index: only the asked users' turns are placed."""
    asked = queries.select("query_id", "user_id", fn.stemmed_words(F.col("query")).alias("terms"))
    placed = recall.placed(index.own(queries, turns))
    return ranking.filled(index.scores("stems", asked, "query_id"), placed, queries, k)


@query("bm25_turn_search_indexed", v.sql(_A + "SELECT query_id, arrival, rank, round(score, 6) AS score FROM ranked WHERE rank <= 20", "turns", "queries"))
def bm25_turn_search_indexed(spark, sf_dir):
    """The same 20 turns from a maintained index, after inserts, deletes and replacements."""
    with Scratch(spark) as scratch:
        turns = scratch.cut(v.turns(spark, sf_dir))
        rows = indexed_ranks(turn_index(spark, f"{scratch.path}/index", turns), turns, v.queries(spark, sf_dir))
        return written(rows.select("query_id", "arrival", "rank", F.round("score", 6).alias("score")), shared_dir(spark, "ranks"))


def _candidates(spark, sf_dir):
    """The 48 best turns of a query's user by the candidate-set score."""
    return ranking.ranked_turns(_placed(spark, sf_dir), v.queries(spark, sf_dir), fn.lexical_tokens, 48, "body", 1)


@query("bm25_rank", v.sql(_B + "SELECT query_id, arrival, rank, round(score, 6) AS score FROM ranked WHERE rank <= 48", "turns", "queries"))
def bm25_rank(spark, sf_dir):
    return _candidates(spark, sf_dir).select("query_id", "arrival", "rank", F.round("score", 6).alias("score"))


_SEL = """SELECT query_id, arrival, k AS rank FROM (SELECT query_id, arrival, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN best > 0 THEN score ELSE 0 END DESC, place, arrival) AS k
FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM scored) WHERE best <= 0 OR score >= 0.5::DOUBLE * best) WHERE k <= 8"""


@query("select_bm25", v.sql(_B + _SEL, "turns", "queries"))
def select_bm25(spark, sf_dir):
    return ranking.select_best(_candidates(spark, sf_dir), "query_id").select("query_id", "arrival", "rank")


_AND = f"""SELECT q.query_id, d.arrival FROM (SELECT query_id, user_id, {s_fts('query')} AS terms FROM queries) q
JOIN (SELECT user_id, arrival, {s_fts('body')} AS terms FROM turns) d ON d.user_id = q.user_id AND len(q.terms) > 0 AND len(list_intersect(q.terms, d.terms)) = len(q.terms)"""


def _unbounded_fts(column):
    raw = F.transform(F.regexp_extract_all(column, F.lit("[A-Za-z0-9][A-Za-z0-9'_-]*"), F.lit(0)), lambda t: F.lower(F.regexp_replace(t, "^['_-]+|['_-]+$", "")))
    return F.array_distinct(F.filter(raw, lambda t: (F.length(t) >= 2) & ~t.isin(*fn.FTS_STOP)))


@query("fts_and_search", v.sql(_AND, "turns", "queries"))
def fts_and_search(spark, sf_dir):
    """Turns of a query's user that have all its words."""
    docs = v.turns(spark, sf_dir).select("user_id", "arrival", _unbounded_fts(F.col("body")).alias("terms"))
    q = v.queries(spark, sf_dir).select("query_id", "user_id", fn.fts_terms(F.col("query")).alias("terms"))
    return ranking.all_terms(docs, q, "user_id", "arrival", "query_id")


_OR = f"""docs AS (SELECT user_id, arrival, list_filter(list_transform(regexp_extract_all(body, '[A-Za-z0-9][A-Za-z0-9''_-]*'), lambda t: lower(trim(t, '''_-'))), lambda t: length(t) >= 2) AS terms FROM turns),
totals AS (SELECT user_id, count(*) AS n, coalesce(nullif(avg(len(terms)), 0), 1.0) AS mean FROM docs GROUP BY user_id),
post AS (SELECT user_id, arrival, dl, term, count(*) AS tf FROM (SELECT user_id, arrival, len(terms) AS dl, unnest(terms) AS term FROM docs) GROUP BY ALL),
freq AS (SELECT user_id, term, count(*) AS df FROM post GROUP BY ALL),
asked AS (SELECT query_id, user_id, unnest({s_fts('query')}) AS term FROM queries),
hits AS (SELECT query_id, arrival, sum(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 0.000001::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))) AS score
  FROM asked JOIN freq USING (user_id, term) JOIN totals USING (user_id) JOIN post USING (user_id, term) GROUP BY ALL)
SELECT query_id, arrival, rank FROM (SELECT query_id, arrival, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, arrival) AS rank FROM hits) WHERE rank <= 24"""


@query("fts_or_search", v.sql(_OR, "turns", "queries"))
def fts_or_search(spark, sf_dir):
    """The 24 best turns that have any word of the query; idf has a small floor."""
    raw = F.transform(F.regexp_extract_all("body", F.lit("[A-Za-z0-9][A-Za-z0-9'_-]*"), F.lit(0)), lambda t: F.lower(F.regexp_replace(t, "^['_-]+|['_-]+$", "")))
    docs = v.turns(spark, sf_dir).select("user_id", "arrival", F.filter(raw, lambda t: F.length(t) >= 2).alias("terms"))
    q = v.queries(spark, sf_dir).select("query_id", "user_id", fn.fts_terms(F.col("query")).alias("terms"))
    scores = ranking.bm25(docs, q, "user_id", "arrival", "query_id", k1=1.2, idf_floor=1e-6)
    return ranking.top(scores, "query_id", 24, F.desc(F.round("score", 9)), "arrival").select("query_id", "arrival", "rank")


_COS = """SELECT query_id, vec_id, rank, score FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id)) WHERE rank <= 10"""


@query("cosine_topk", _COS)
def cosine_topk(spark, sf_dir):
    """Ten neighbours among all vectors for every vector whose id is divisible by 100."""
    e = v.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ranking.cosine_topk(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")))


_TL = f"""SELECT query_id, node_id, rank FROM (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, t_sort, node_id) AS rank
FROM (SELECT q.query_id, t.node_id, t.t_sort, len(list_filter(q.toks, lambda x: contains(lower(n.content), {s_stem('x')}))) AS hits
  FROM (SELECT query_id, user_id, {s_query_tokens('query')} AS toks FROM queries) q JOIN timeline t ON t.user_id = q.user_id JOIN nodes n ON n.id = t.node_id) WHERE hits > 0) WHERE rank <= 12"""


@query("timeline_search", v.sql(_TL, "queries", "timeline", "nodes"))
def timeline_search(spark, sf_dir):
    """Dated nodes of a query's user by token hits, earliest first among equals."""
    q = v.queries(spark, sf_dir).select("query_id", "user_id", fn.query_tokens(F.col("query")).alias("toks"))
    n = v.nodes(spark, sf_dir).select(F.col("id").alias("node_id"), "content")
    rows = v.timeline(spark, sf_dir).select("user_id", "node_id", "t_sort").join(n, "node_id").join(q, "user_id")
    rows = rows.withColumn("hits", fn.stem_hits(F.col("toks"), F.col("content"))).where("hits > 0")
    return ranking.top(rows, "query_id", 12, F.desc("hits"), "t_sort", "node_id").select("query_id", "node_id", "rank")


@query("timeline_candidates", v.sql(f"SELECT query_id, node_id FROM (SELECT q.query_id, t.node_id, row_number() OVER (PARTITION BY q.query_id ORDER BY t.t_sort, t.node_id) AS k FROM (SELECT query_id, user_id, {s_query_tokens('query')} AS toks FROM queries) q JOIN timeline t ON t.user_id = q.user_id JOIN nodes n ON n.id = t.node_id WHERE len(list_filter(q.toks, lambda x: contains(lower(n.content || ' ' || t.t_label || ' ' || t.entity), {s_stem('x')}))) > 0) WHERE k <= 400", "queries", "timeline", "nodes"))
def timeline_candidates(spark, sf_dir):
    """Timeline rows with a token's stem in text, label or entity; the first 400 of a query by time."""
    q = v.queries(spark, sf_dir).select("query_id", "user_id", fn.query_tokens(F.col("query")).alias("toks"))
    n = v.nodes(spark, sf_dir).select(F.col("id").alias("node_id"), "content")
    rows = v.timeline(spark, sf_dir).join(n, "node_id").join(q, "user_id")
    rows = rows.where(fn.stem_hits(F.col("toks"), F.concat_ws(" ", "content", "t_label", "entity")) > 0)
    return ranking.top(rows, "query_id", 400, "t_sort", "node_id").select("query_id", "node_id")


_HITS = f"""asked AS (SELECT query_id, user_id, flatten({s_sides('query')}) AS toks FROM queries),
touched AS (SELECT * FROM (SELECT query_id, arrival, toks, len(list_filter(toks, lambda t: contains(lower(turn_text), {s_stem('t')}))) AS hits FROM asked JOIN turns USING (user_id)) WHERE hits > 0 OR len(toks) = 0),
ranked AS (SELECT query_id, arrival, arrival AS place, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, arrival) AS rank FROM touched)
"""
_SPREAD = """SELECT query_id, arrival FROM (SELECT query_id, arrival, row_number() OVER (PARTITION BY query_id ORDER BY winner DESC, rank) AS pick
FROM (SELECT *, n > 8 AND row_number() OVER (PARTITION BY query_id, bin ORDER BY rank) = 1 AS winner
  FROM (SELECT *, least(7, floor((place - lo) / ((hi - lo + 1) / 8.0::DOUBLE))) AS bin
    FROM (SELECT *, min(place) OVER w AS lo, max(place) OVER w AS hi, count(*) OVER w AS n FROM ranked WINDOW w AS (PARTITION BY query_id))))) WHERE pick <= 8"""


@query("spread_by_position_whole", v.sql(_HITS + _SPREAD, "turns", "queries"))
@query("spread_by_position", v.sql(_HITS + _SPREAD, "turns", "queries"))
def spread_by_position(spark, sf_dir):
    """Eight turns that cover a user's whole history, of all that have a token of the query."""
    t = v.turns(spark, sf_dir).select("user_id", "arrival", F.col("arrival").alias("position"), F.col("turn_text").alias("content"))
    return recall.spread(recall.transcript_hits(t, v.queries(spark, sf_dir)), "query_id", 8).select("query_id", "arrival")


_ORD = v.sql(_HITS + _SPREAD.replace("SELECT query_id, arrival FROM (SELECT query_id, arrival, row_number()", "SELECT query_id, arrival, row_number() OVER (PARTITION BY query_id ORDER BY arrival) AS ord FROM (SELECT query_id, arrival, row_number()", 1), "turns", "queries")


@query("transcript_search_whole", _ORD)
@query("transcript_search", _ORD)
def transcript_search(spark, sf_dir):
    """The same picks in mention order."""
    rows = spread_by_position(spark, sf_dir)
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("query_id").orderBy("arrival")).cast("long"))


@query("transcript_chunks")
def transcript_chunks(spark, sf_dir):
    """Eight chunks of at most 200 characters that cover a user's history, in mention order."""
    t = v.turns(spark, sf_dir).select("user_id", "arrival", F.col("arrival").alias("position"), F.col("turn_text").alias("content"))
    rows = recall.spread(recall.transcript_chunks(t, v.queries(spark, sf_dir), 200), "query_id", 8)
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("position")).cast("long")
    return rows.select("query_id", "arrival", "chunk", "piece", "hits", order.alias("ord"))


_WIN = "SELECT DISTINCT r.query_id, t.session_id, t.position FROM ranked r JOIN turns t ON t.session_id = r.session_id AND t.position BETWEEN r.position - 1 AND r.position + 1 WHERE r.rank <= 5"


def _hits(spark, sf_dir, k):
    t = v.turns(spark, sf_dir).select("arrival", "session_id", "position", "turn_text")
    return _turn_ranks(spark, sf_dir, k).select("query_id", "arrival", "rank").join(t, "arrival")


@query("window_expand", v.sql(_A + _WIN, "turns", "queries"))
def window_expand(spark, sf_dir):
    """The turns around each of a query's five best."""
    return recall.expand_windows(_hits(spark, sf_dir, 5), v.turns(spark, sf_dir), 1)


@query("hit_windows")
def hit_windows(spark, sf_dir):
    return recall.hit_spans(_hits(spark, sf_dir, 10), 1)


_STAMP = "strftime(to_timestamp({})::TIMESTAMP, '%Y-%m-%dT%H:%M:%S+00:00')"
_ITEMS = f"""SELECT a.query_id, a.rank, a.id, a.content, {_STAMP.format("a.said_at")} AS created_at FROM (SELECT query_id, trim(turn_text) AS content, min(r.rank) AS rank, arg_min(r.arrival, r.rank) AS id, arg_min(t.said_at, r.rank) AS said_at
    FROM ranked r JOIN turns t USING (arrival, turn_text) WHERE r.rank <= 20 AND trim(turn_text) <> '' GROUP BY ALL) a
WHERE NOT EXISTS (SELECT 1 FROM ranked b WHERE b.rank <= 20 AND b.query_id = a.query_id AND trim(b.turn_text) <> a.content AND contains(trim(b.turn_text), a.content))"""


def _ranked_hits(spark, sf_dir, k=20):
    return _turn_ranks(spark, sf_dir, k).select("query_id", "rank", F.col("arrival").alias("id"))


@query("search_items", v.sql(_A + _ITEMS, "turns", "queries"))
def search_items(spark, sf_dir):
    """What a search returns: a query's best turns, none twice or within another."""
    return recall.search_items(_ranked_hits(spark, sf_dir), v.turns(spark, sf_dir))


@query("search_items_windows")
def search_items_windows(spark, sf_dir):
    """The same with the turns around each hit; claims among the hits stand for their turns."""
    rows, turns = _ranked_hits(spark, sf_dir), v.turns(spark, sf_dir)
    claims = derived.claims(turns).select("id", F.col("arrival").alias("source"))
    first = claims.groupBy("source").agg(F.min("id").alias("claim")).withColumnRenamed("source", "id")
    rows = rows.join(first, "id", "left").select("query_id", "rank", F.when(F.col("rank") % 2 == 0, F.coalesce("claim", "id")).otherwise(F.col("id")).alias("id"))
    return recall.search_items(rows, turns, claims, 1)


@query("search_items_sessions")
def search_items_sessions(spark, sf_dir):
    """The same with whole sessions."""
    return recall.search_items(_ranked_hits(spark, sf_dir), v.turns(spark, sf_dir), whole_session=True, k=20)


@query("render_memories", v.sql(_A + "SELECT query_id, string_agg('- [' || coalesce(strftime(to_timestamp(t.said_at)::TIMESTAMP, '%Y-%m-%d'), 'unknown') || '] ' || r.turn_text, chr(10) ORDER BY rank) AS block FROM ranked r JOIN turns t USING (arrival) WHERE rank <= 5 GROUP BY query_id", "turns", "queries"))
def render_memories(spark, sf_dir):
    """A query's five best turns as dated lines."""
    said = v.turns(spark, sf_dir).select("arrival", "said_at")
    stamp = F.coalesce(F.date_format(F.timestamp_seconds("said_at"), "yyyy-MM-dd"), F.lit("unknown"))
    rows = _hits(spark, sf_dir, 5).join(said, "arrival").withColumn("line", F.concat(F.lit("- ["), stamp, F.lit("] "), "turn_text"))
    return recall.joined(rows, ["query_id"], ["rank"], "line").withColumnRenamed("content", "block")


@query("fit_prefix", v.sql(_A + f"SELECT query_id, count(*) AS n, max(used)::BIGINT AS tokens FROM (SELECT query_id, sum({s_tokens('turn_text')}) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM ranked WHERE rank <= 20) WHERE used <= 1000 GROUP BY query_id", "turns", "queries"))
def fit_prefix(spark, sf_dir):
    """How many of a query's best turns fit in 1,000 estimated tokens, from the first."""
    rows = _hits(spark, sf_dir, 20).withColumn("cost", fn.estimate_tokens(F.col("turn_text")))
    kept = recall.prefix_within(rows, "query_id", ["rank"], "cost", 1000)
    return kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("used").alias("tokens"))


@query("prove_pack", v.sql(_A + "SELECT query_id, count(*) AS n, max(used)::BIGINT AS chars FROM (SELECT query_id, sum(length(left(turn_text, 2000)) + 5) OVER (PARTITION BY query_id ORDER BY rank) - 5 AS used FROM ranked WHERE rank <= 20) WHERE used <= 10000 GROUP BY query_id", "turns", "queries"))
def prove_pack(spark, sf_dir):
    """Whole passages of at most 2,000 characters, five between, up to 10,000."""
    rows = _hits(spark, sf_dir, 20).withColumn("cost", F.length(F.left("turn_text", F.lit(2000))).cast("long"))
    kept = recall.prefix_within(rows, "query_id", ["rank"], "cost", 10_000, 5)
    return kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("used").alias("chars"))


@query("cap_evidence", v.sql("SELECT arrival, left(turn_text, 100) AS capped FROM turns", "turns"))
def cap_evidence(spark, sf_dir):
    """A prefix cap at 100 tokens of one character each."""
    return v.turns(spark, sf_dir).select("arrival", F.left("turn_text", F.lit(100)).alias("capped"))


_MERGE = f"""{_PLACED}, whole AS (SELECT user_id, session_id, session_rank, first_said, string_agg(turn_text, chr(10) ORDER BY position) AS content FROM placed GROUP BY ALL),
sized AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM whole)
SELECT user_id, (session_rank - 1) // ceil(n / 4)::BIGINT AS item, string_agg(CASE WHEN n > 4 AND first_said IS NOT NULL THEN '(conversation on ' || strftime(to_timestamp(first_said)::TIMESTAMP, '%Y-%m-%d') || ')' || chr(10) ELSE '' END || content, chr(10) ORDER BY session_rank) AS content
FROM sized GROUP BY ALL"""


@query("merge_neighbours", v.sql(_MERGE, "turns"))
def merge_neighbours(spark, sf_dir):
    """Every history merged to at most four items."""
    return recall.merged(recall.sessions(v.turns(spark, sf_dir)), 4)


@query("full_recall_fit", v.sql(_MERGE.replace("SELECT user_id, (session", "SELECT user_id, item, content, tokens, sum(tokens) OVER (PARTITION BY user_id) <= 100000 AS fits FROM (SELECT *, " + s_tokens("content") + " AS tokens FROM (SELECT user_id, (session") + "))", "turns"))
def full_recall_fit(spark, sf_dir):
    return recall.full_recall(v.turns(spark, sf_dir), top_k=4)


_BLOCKS = """WITH RECURSIVE turns AS (TURNS), walk AS (
  SELECT user_id, session_id, position, length(turn_text) + 1 AS size, 0::BIGINT AS block FROM turns WHERE position = 0
  UNION ALL
  SELECT t.user_id, t.session_id, t.position, CASE WHEN w.size + length(t.turn_text) + 1 > 1500 THEN length(t.turn_text) + 1 ELSE w.size + length(t.turn_text) + 1 END,
    w.block + CASE WHEN w.size + length(t.turn_text) + 1 > 1500 THEN 1 ELSE 0 END
  FROM walk w JOIN turns t ON t.session_id = w.session_id AND t.position = w.position + 1)
SELECT user_id, session_id, position, block FROM walk""".replace("TURNS", v.SQL["turns"])


@query("recall_blocks", _BLOCKS)
def recall_blocks(spark, sf_dir):
    """Sessions cut into blocks of about 1,500 characters."""
    return recall.blocks(v.turns(spark, sf_dir), 1500)


_KNAP = """WITH RECURSIVE turns AS (TURNS), units AS (SELECT user_id, arrival, TOKENS AS cost, row_number() OVER (PARTITION BY user_id ORDER BY arrival) AS ord FROM turns), walk AS (
  SELECT user_id, ord, arrival, cost <= 1000 AS chosen, CASE WHEN cost <= 1000 THEN cost ELSE 0 END AS used FROM units WHERE ord = 1
  UNION ALL
  SELECT u.user_id, u.ord, u.arrival, w.used + u.cost <= 1000, w.used + CASE WHEN w.used + u.cost <= 1000 THEN u.cost ELSE 0 END FROM walk w JOIN units u ON u.user_id = w.user_id AND u.ord = w.ord + 1)
SELECT user_id, arrival, chosen FROM walk""".replace("TURNS", v.SQL["turns"]).replace("TOKENS", s_tokens("turn_text"))


@query("recall_knapsack", _KNAP)
def recall_knapsack(spark, sf_dir):
    """Turns taken in order while they fit in 1,000 tokens, skipping those that don't."""
    w = Window.partitionBy("user_id").orderBy("arrival")
    units = v.turns(spark, sf_dir).select("user_id", "arrival", F.row_number().over(w).cast("long").alias("ord"), fn.estimate_tokens(F.col("turn_text")).alias("cost"))
    return recall.knapsack(units, "user_id", 1000).select("user_id", "arrival", "chosen")


@query("full_recall_over")
def full_recall_over(spark, sf_dir):
    """What a recall returns when a history must fit in 2,000 tokens and six items, for every query."""
    hits = _turn_ranks(spark, sf_dir, recall.FOCUS_TURNS)
    return recall.recalled(v.turns(spark, sf_dir), v.queries(spark, sf_dir), hits, fn.stemmed_words, 2000, 6)


@query("memory_block", v.sql(_A + "SELECT query_id, CASE WHEN max(score) > 0 THEN string_agg(turn_text, chr(10) || '---' || chr(10) ORDER BY rank) ELSE '' END AS block FROM ranked WHERE rank <= 8 GROUP BY query_id", "turns", "queries"))
def memory_block(spark, sf_dir):
    """A query's eight best turns as one block, withheld if nothing matched."""
    rows = _turn_ranks(spark, sf_dir, 8).join(v.turns(spark, sf_dir).select("arrival", "turn_text"), "arrival")
    block = recall.joined(rows, ["query_id"], ["rank"], "turn_text", "\n---\n")
    best = rows.groupBy("query_id").agg(F.max("score").alias("best"))
    return block.join(best, "query_id").select("query_id", F.when(F.col("best") > 0, F.col("content")).otherwise("").alias("block"))
