"""Queries of the text functions, each over every turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions import text as fn
from turnloom.plans import views as v
from turnloom.plans.catalog import flat, query


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


# DuckDB spellings of the text functions.
def s_stem(t: str) -> str:
    return f"left(regexp_replace(trim(replace(lower({t}), '''s', ''), '''-'), '^(.{{3,}})(ing|ed)$', '\\1'), 5)"


def s_query_tokens(t: str) -> str:
    raw = f"list_transform(regexp_extract_all(lower({t}), '[a-z0-9][a-z0-9''-]*'), lambda t: trim(t, '''-'))"
    return f"list_distinct(list_filter({raw}, lambda t: length(t) >= 3 AND NOT list_contains({_list(fn.QUERY_STOP)}, t)))"


def s_words(t: str) -> str:
    return f"list_transform(regexp_extract_all(lower({t}), '[a-z0-9'']+'), lambda t: {s_stem('t')})"


def s_lexical(t: str) -> str:
    raw = f"list_filter(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+'), lambda t: length(t) >= 2 AND NOT list_contains({_list(fn.LEXICAL_STOP)}, t))"
    return f"list_transform({raw}, lambda t: CASE WHEN length(t) > 4 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) ELSE t END)"


def s_fts(t: str) -> str:
    raw = f"list_transform(regexp_extract_all({t}, '[A-Za-z0-9][A-Za-z0-9''_-]*'), lambda t: lower(trim(t, '''_-')))"
    return f"list_distinct(list_filter({raw}, lambda t: length(t) >= 2 AND NOT list_contains({_list(fn.FTS_STOP)}, t)))"


def s_tokens(t: str) -> str:
    spaces = "\\s\\x{0b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1c}-\\x{1f}"
    return f"ceil(1.05::DOUBLE * len(regexp_extract_all({t}, '[A-Za-z]+|[0-9]|[^{spaces}A-Za-z0-9]')))::BIGINT"


def s_sentences(t: str) -> str:
    cut = f"regexp_replace(regexp_replace({t}, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def s_flat(items: str) -> str:
    return f"array_to_string(list_sort({items}), ' ')"


def _turns(spark, sf_dir):
    return v.turns(spark, sf_dir)


@query("query_tokens", v.sql(f"SELECT arrival, {s_flat(s_query_tokens('body'))} AS tokens FROM turns", "turns"))
def query_tokens(spark, sf_dir):
    return _turns(spark, sf_dir).select("arrival", flat(fn.query_tokens(F.col("body"))).alias("tokens"))


@query("stem_tokens", v.sql(f"SELECT arrival, array_to_string({s_words('turn_text')}, ' ') AS stems FROM turns", "turns"))
def stem_tokens(spark, sf_dir):
    return _turns(spark, sf_dir).select("arrival", F.array_join(fn.stemmed_words(F.col("turn_text")), " ").alias("stems"))


@query("lexical_tokens", v.sql(f"SELECT arrival, array_to_string({s_lexical('body')}, ' ') AS tokens FROM turns", "turns"))
def lexical_tokens(spark, sf_dir):
    return _turns(spark, sf_dir).select("arrival", F.array_join(fn.lexical_tokens(F.col("body")), " ").alias("tokens"))


_FTS = """SELECT arrival, array_to_string(list_sort(list_transform(list_filter(list_zip(terms, range(len(terms))), lambda x: x[2] < 16), lambda x: x[1])), ' ') AS terms
FROM (SELECT arrival, list_transform(list_sort(list_transform(list_distinct(raw), lambda t: {'p': list_position(raw, t), 't': t})), lambda x: x.t) AS terms
      FROM (SELECT arrival, RAW AS raw FROM turns))""".replace("RAW", s_fts("body").removeprefix("list_distinct(").removesuffix(")"))


@query("fts_terms", v.sql(_FTS, "turns"))
def fts_terms(spark, sf_dir):
    return _turns(spark, sf_dir).select("arrival", flat(fn.fts_terms(F.col("body"))).alias("terms"))


@query("estimate_tokens", v.sql(f"SELECT arrival, {s_tokens('turn_text')} AS tokens FROM turns", "turns"))
def estimate_tokens(spark, sf_dir):
    return _turns(spark, sf_dir).select("arrival", fn.estimate_tokens(F.col("turn_text")).alias("tokens"))


@query("sentences", v.sql(f"SELECT arrival, array_to_string({s_sentences('body')}, chr(10)) AS sentences FROM turns", "turns"))
def sentences(spark, sf_dir):
    return _turns(spark, sf_dir).select("arrival", F.array_join(fn.sentences(F.col("body")), "\n").alias("sentences"))


_CLAUSES = """SELECT arrival, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(body, '([0-9]{1,2}(?:st|nd|rd|th)?),\\s+([0-9]{4})\\b', '\\1 \\2', 'g'),
  '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+|[,;]\\s+', chr(1), 'g'), '(?i)\\s+(?:and|but|while)\\s+', chr(1), 'g'), chr(1)),
  lambda c: trim(c) <> ''), '|') AS clauses FROM turns"""


@query("clauses", v.sql(_CLAUSES, "turns"))
def clauses(spark, sf_dir):
    return _turns(spark, sf_dir).select("arrival", F.array_join(fn.clauses(F.col("body")), "|").alias("clauses"))


@query(
    "snippets",
    v.sql("""SELECT arrival, CASE WHEN length(f) <= 90 THEN f ELSE left(f, 89) || '…' END AS snippet
FROM (SELECT arrival, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS f FROM turns)""", "turns"),
)
def snippets(spark, sf_dir):
    return _turns(spark, sf_dir).select("arrival", fn.clipped(F.col("body"), 90).alias("snippet"))


@query("first_entity", v.sql("SELECT arrival, nullif(regexp_extract(body, '(?:^|[^\\p{L}\\p{N}_])([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)?)(?:[^\\p{L}\\p{N}_]|$)', 1), '') AS entity FROM turns", "turns"))
def first_entity(spark, sf_dir):
    return _turns(spark, sf_dir).select("arrival", fn.first_entity(F.col("body")).alias("entity"))


_CLAIMS = f"""SELECT arrival, k AS claim, left(s, 580) AS text FROM (
  SELECT arrival, s, row_number() OVER (PARTITION BY arrival ORDER BY i) AS k
  FROM (SELECT arrival, unnest({s_sentences('body')}) AS s, generate_subscripts({s_sentences('body')}, 1) AS i FROM turns)
  WHERE length(s) >= 20 AND len(list_filter({_list(fn.CLAIM_TRIGGERS)}, lambda w: contains(lower(s), w))) > 0)
WHERE k <= 6"""


@query("claim_candidates", v.sql(_CLAIMS, "turns"))
def claim_candidates(spark, sf_dir):
    """The first six sentences of every turn that could be claims."""
    found = F.slice(F.filter(fn.sentences(F.col("body")), fn.is_claim), 1, 6)
    rows = _turns(spark, sf_dir).select("arrival", F.posexplode(found).alias("k", "s"))
    return rows.select("arrival", (F.col("k") + 1).cast("long").alias("claim"), F.left("s", F.lit(580)).alias("text"))


@query("preference_text", f"SELECT doc_id FROM documents WHERE len(list_filter({_list(fn.PREFERENCE)}, lambda w: contains(lower(text), w))) > 0")
def preference_text(spark, sf_dir):
    """Whole texts that speak of a preference."""
    return v.table(spark, sf_dir, "documents").where(fn.is_preference(F.col("text"))).select("doc_id")


def _case(column: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(lower({column}), '{p}') THEN '{n}'" for n, p in fn.ABILITIES)
    return f"CASE {whens} ELSE 'default' END"


_PHRASED = "CASE arrival % 6 WHEN 0 THEN 'When did ' WHEN 1 THEN 'Which came first, ' WHEN 2 THEN 'What is ' WHEN 3 THEN 'You said ' WHEN 4 THEN 'I always liked ' ELSE 'Hm, ' END || body"


@query(
    "ability_route",
    v.sql(f"""SELECT arrival, ability, ability IN ('contradiction', 'temporal', 'event_ordering') AS historical,
  CASE WHEN ability IN ('contradiction', 'temporal', 'event_ordering') THEN 16 ELSE 8 END::BIGINT AS k
FROM (SELECT arrival, {_case('q')} AS ability FROM (SELECT arrival, {_PHRASED} AS q FROM turns))""", "turns"),
)
def ability_route(spark, sf_dir):
    rows = _turns(spark, sf_dir).select("arrival", F.expr(_PHRASED).alias("q"))
    a = F.col("ability")
    return rows.select("arrival", fn.ability(F.col("q")).alias("ability")).select(
        "arrival", "ability", a.isin(*fn.HISTORICAL).alias("historical"), fn.ability_k(a, 8).alias("k")
    )


_ASKED = "CASE arrival % 4 WHEN 0 THEN 'List three items I mentioned: ' WHEN 1 THEN 'List 12 events: ' WHEN 2 THEN 'What was discussed: ' ELSE '' END || body"
_LENGTHS = " ".join(f"WHEN regexp_matches(q, '(?i)\\b{w}\\s+{fn.COUNTABLE}\\b') THEN {n}" for n, w in enumerate(fn.NUMBERS, 1))


@query(
    "sequence_questions",
    v.sql(f"""SELECT arrival, regexp_matches(q, '{fn.MENTIONS}') AS by_mention,
  CASE WHEN regexp_matches(q, '(?i)\\b([0-9]+)\\s+{fn.COUNTABLE}\\b') THEN regexp_extract(q, '(?i)\\b([0-9]+)\\s+{fn.COUNTABLE}\\b', 1)::BIGINT {_LENGTHS} END::BIGINT AS wanted
FROM (SELECT arrival, {_ASKED} AS q FROM turns)""", "turns"),
)
def sequence_questions(spark, sf_dir):
    q = F.col("q")
    rows = _turns(spark, sf_dir).select("arrival", F.expr(_ASKED).alias("q"))
    return rows.select("arrival", q.rlike(fn.MENTIONS).alias("by_mention"), fn.requested_length(q).alias("wanted"))


_SIDED = "'between ' || array_to_string(string_split(body, ' ')[1:4], ' ') || ' and ' || array_to_string(string_split(body, ' ')[5:8], ' ') || '?'"


def s_sides(q: str) -> str:
    """The token lists of the events that ``q`` compares, as lists of lists."""
    piece = lambda pattern, n: s_query_tokens(f"regexp_extract({q}, '{pattern}', {n})")
    between, since = (f"(?i)\\b{x}\\s+(.+?)\\s+{y}\\s+(.+?)(?:\\?|\\n?$)" for x, y in (("between", "and"), ("since", "when")))
    parts = f"regexp_split_to_array({q}, '(?i)\\bor\\b')"
    head = s_query_tokens(f"regexp_extract({parts}[1], '[^,:;]*$')")
    left = f"CASE WHEN len({head}) > 0 THEN {head} ELSE {s_query_tokens(parts + '[1]')} END"
    right = s_query_tokens(f"{parts}[2]")
    both = lambda x, y: f"len({x}) > 0 AND len({y}) > 0 THEN [{x}, {y}]"
    return f"""CASE WHEN {both(piece(between, 1), piece(between, 2))} WHEN {both(piece(since, 1), piece(since, 2))}
  WHEN len({parts}) = 2 AND {both(left, right)} ELSE [{s_query_tokens(q)}] END"""


_SPLIT = v.sql(f"""SELECT arrival, array_to_string(list_transform({s_sides('q')}, lambda s: {s_flat('s')}), ' / ') AS sides
FROM (SELECT arrival, {_SIDED} AS q FROM turns)""", "turns")


@query("split_sides_whole", _SPLIT)
@query("split_sides", _SPLIT)
def split_sides(spark, sf_dir):
    """Every turn: 'between A and B', else 'since A when B', else 'A or B', else one side."""
    return turn_sides(_turns(spark, sf_dir))


def turn_sides(turns):
    """arrival, sides of every row of ``turns`` (arrival, body)."""
    parts = F.split("body", " ")
    q = F.concat(F.lit("between "), F.array_join(F.slice(parts, 1, 4), " "), F.lit(" and "), F.array_join(F.slice(parts, 5, 4), " "), F.lit("?"))
    sides = F.transform(fn.sides(q), flat)
    return turns.select("arrival", F.array_join(sides, " / ").alias("sides"))


@query("body_sides", v.sql(f"SELECT arrival, array_to_string(list_transform({s_sides('body')}, lambda s: {s_flat('s')}), ' / ') AS sides FROM turns", "turns"))
def body_sides(spark, sf_dir):
    """The same of every whole body as it stands."""
    return _turns(spark, sf_dir).select("arrival", F.array_join(F.transform(fn.sides(F.col("body")), flat), " / ").alias("sides"))


@query("session_hash", v.sql("SELECT DISTINCT session_id, sha256(session_id::VARCHAR) AS hash FROM turns", "turns"))
def session_hash(spark, sf_dir):
    return _turns(spark, sf_dir).select("session_id", F.sha2(F.col("session_id").cast("string"), 256).alias("hash")).distinct()


@query("types_map", "SELECT event_id, (json_extract(props, '$.k'))::DOUBLE AS k FROM events")
def types_map(spark, sf_dir):
    """The types map of a node is JSON text; here the one of every event."""
    props = F.from_json("props", "map<string,double>")
    return v.table(spark, sf_dir, "events").select("event_id", F.try_element_at(props, F.lit("k")).alias("k"))


_DENSE = f"""SELECT arrival, coalesce(list_max(list_transform(range(0, greatest(1, length(body) - 160), 160),
  lambda s: len(list_filter(toks, lambda t: contains(substr(lower(body), s + 1, 320), {s_stem('t')})))::BIGINT)), 0) AS hits
FROM (SELECT arrival, body, {s_query_tokens('left(body, 60)')} AS toks FROM turns)"""


@query("densest_hits", v.sql(_DENSE, "turns"))
def densest_hits(spark, sf_dir):
    """Token hits of a turn's first 60 characters in the densest window of the whole turn."""
    rows = _turns(spark, sf_dir).select("arrival", "body", fn.query_tokens(F.left("body", F.lit(60))).alias("t"))
    return rows.select("arrival", fn.densest_hits(F.col("body"), F.col("t")).alias("hits"))


@query(
    "clip_truncations",
    v.sql("SELECT doc_id, length(text) AS chars, left(text, 2000) AS clipped FROM documents WHERE length(text) > 2000"),
)
def clip_truncations(spark, sf_dir):
    """Whole texts are measured; the clip at 2,000 characters is the operation itself."""
    d = v.table(spark, sf_dir, "documents").where(F.length("text") > 2000)
    return d.select("doc_id", F.length("text").cast("long").alias("chars"), F.left("text", F.lit(2000)).alias("clipped"))


@query("turn_text", v.sql("SELECT arrival, user_id, session_id, position, role, turn_text FROM turns", "turns"))
def turn_text(spark, sf_dir):
    """A stored turn's header parsed back from its text form."""
    t = _turns(spark, sf_dir)
    # fixed format: the header of a stored turn
    head = F.format_string("[AML] session=%s position=%d turn=%d %s:\n", F.sha2(F.col("session_id").cast("string"), 256), "position", "position", "role")
    pattern = r"^\[AML\] session=(\S+) position=(\d+) turn=\d+ (user|assistant):(?: date=\S+)?\n"
    c = t.withColumn("content", F.concat(head, "body"))
    part = lambda k: F.regexp_extract("content", pattern, k)
    return c.select(
        "arrival",
        "user_id",
        "session_id",
        part(2).cast("long").alias("position"),
        part(3).alias("role"),
        F.concat(part(3), F.lit(": "), F.regexp_replace("content", pattern, "")).alias("turn_text"),
    )


@query("validate_messages", """SELECT role, CASE WHEN role NOT IN ('user', 'assistant') THEN 'role' WHEN text = '' THEN 'content' ELSE 'ok' END AS verdict,
  count(*) AS n FROM conversations GROUP BY ALL""")
def validate_messages(spark, sf_dir):
    verdict = F.when(~F.col("role").isin("user", "assistant"), "role").when(F.col("text") == "", "content").otherwise("ok")
    return v.table(spark, sf_dir, "conversations").groupBy("role", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("doc_frequency", v.sql(f"SELECT user_id, term, count(DISTINCT arrival) AS df FROM (SELECT user_id, arrival, unnest({s_words('turn_text')}) AS term FROM turns) GROUP BY ALL", "turns"))
def doc_frequency(spark, sf_dir):
    rows = _turns(spark, sf_dir).select("user_id", "arrival", F.explode(F.array_distinct(fn.stemmed_words(F.col("turn_text")))).alias("term"))
    return rows.groupBy("user_id", "term").agg(F.count(F.lit(1)).alias("df"))


@query("term_stats", v.sql(f"SELECT user_id, count(*) AS n, sum(len({s_words('turn_text')}))::BIGINT AS terms, round(avg(len({s_words('turn_text')})), 6) AS mean FROM turns GROUP BY user_id", "turns"))
def term_stats(spark, sf_dir):
    rows = _turns(spark, sf_dir).select("user_id", F.size(fn.stemmed_words(F.col("turn_text"))).alias("dl"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("terms"), F.round(F.avg("dl"), 6).alias("mean"))


@query("history_tokens", v.sql(f"SELECT user_id, sum({s_tokens('turn_text')})::BIGINT AS tokens FROM turns GROUP BY user_id", "turns"))
def history_tokens(spark, sf_dir):
    return _turns(spark, sf_dir).groupBy("user_id").agg(F.sum(fn.estimate_tokens(F.col("turn_text"))).alias("tokens"))
