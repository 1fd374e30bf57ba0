"""The routed retrieval of many questions at once: gather by ability, fuse, sort, expand, check, widen.

A question sees its own user's nodes only, and all statistics are those of that user's store or, in
the final sort, of the question's own candidates. Orders are numbers: a smaller ``o`` comes first.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import dates, text
from turnloom.operators import ranking, recall, store, temporal
from turnloom.sources.postings import Field, PostingIndex
from turnloom.sources.shared import Scratch, shared_dir, written

#: Candidates of a first pass, of a recency list and of the timeline, and hits that a
#: name, a phrase or one side of an alternative may add.
CANDIDATES, RECENT, TIMELINE, NAMED = 48, 80, 400, 6
#: Words that frame a question about the order of mentions.
MENTION_STOP = """list sequence different aspects brought up talked discussed asked topics topic items item
things thing across throughout conversations conversation mentioned mention only
two three four five six seven eight nine ten""".split()
#: Characters that a proof reads in all, what stands between two of its passages, and
#: characters of a passage that a trace shows.
PROOF_CHARS, BETWEEN, TRACE_CHARS = 10_000, 5, 6000


class Memory(NamedTuple):
    """The relations of a store, each with user_id: nodes (id, content, ts, tier, valid_from, valid_to,
    source_position, source_role), timeline (node_id, t_sort, t_label, entity, t_kind), conflicts
    (id, a_id, b_id, topic, ts) and edges (src, dst, kind, score)."""

    nodes: DataFrame
    timeline: DataFrame
    conflicts: DataFrame
    edges: DataFrame


class Prepared(NamedTuple):
    """What the searches of one call share: the ``index`` of the nodes' words, each user's newest
    nodes with their tokens, and the folder of intermediate results."""

    index: PostingIndex
    recent: DataFrame
    scratch: Scratch


def _numbered(rows: DataFrame, by: str, most=None) -> DataFrame:
    """by, id, o: every id once, at its first place, numbered from 1; the first ``most`` of them."""
    first = rows.groupBy(by, "id").agg(F.min("o").alias("o"))
    first = first.withColumn("o", F.row_number().over(Window.partitionBy(by).orderBy("o", "id")).cast("long"))
    return first if most is None else first.where(F.col("o") <= most)


def _after(rows: DataFrame, group: int) -> DataFrame:
    """``rows`` behind those of every lower group; a group has less than a million."""
    return rows.withColumn("o", F.col("o") + group * 1_000_000)


def _indexed(column: Column) -> Column:
    return F.regexp_extract_all(F.lower(column), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _ranked_words(column: Column) -> Column:
    raw = F.transform(F.regexp_extract_all(column, F.lit("[A-Za-z0-9][A-Za-z0-9'_-]*"), F.lit(0)), lambda t: F.lower(F.regexp_replace(t, "^['_-]+|['_-]+$", "")))
    return F.filter(raw, lambda t: F.length(t) >= 2)


#: The fields that a store's index has for the word searches.
FIELDS = {"words": Field(_indexed), "ranked": Field(_ranked_words)}


def prepared(nodes: DataFrame, scratch: Scratch, index: PostingIndex | None = None) -> Prepared:
    """``index`` has the FIELDS of ``nodes``; without one the nodes are indexed for this call."""
    if index is None:
        index = PostingIndex(nodes.sparkSession, f"{scratch.path}/index", FIELDS, buckets=1)  # all users are asked
        index.apply("nodes", nodes.select("user_id", "id", "content"))
    nodes = nodes if "lexical" in nodes.columns else _tokenised(nodes)
    return Prepared(index, scratch.cut(newest(nodes, RECENT).select("user_id", "id", "place", F.col("lexical").alias("terms"))), scratch)


def _tokenised(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("lexical", text.lexical_tokens(F.col("content")))


def _own(asked: DataFrame, memory: Memory, scratch: Scratch) -> Memory:
    """What ``memory`` holds of the asked users, read once; its nodes with their tokens."""
    users = scratch.cut(asked.select("user_id").distinct())
    memory = memory._replace(nodes=_tokenised(memory.nodes))
    return Memory(*(scratch.cut(x.join(users, "user_id", "left_semi")) for x in memory))


def word_search(asked: DataFrame, index: PostingIndex) -> DataFrame:
    """ask, id, o: nodes with all of the first 12 words, then those with any distinctive word by BM25.

    ``asked`` has ask, user_id, words and most. Fewer than two distinctive words: the former only.
    """
    first = F.array_join(F.slice(F.filter(F.split(F.translate("words", '"', " "), r"\s+"), lambda t: t != ""), 1, 12), " ")
    whole = asked.select("ask", "user_id", F.array_distinct(_indexed(first)).alias("terms"))
    exact = index.with_all("words", whole, "ask")
    exact = exact.withColumn("o", F.row_number().over(Window.partitionBy("ask").orderBy("id")).cast("long"))
    some = asked.select("ask", "user_id", text.fts_terms(F.col("words")).alias("terms")).where(F.size("terms") >= 2)
    scores = index.scores("ranked", some, "ask", k1=1.2, idf_floor=1e-6)
    rank = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc(F.round("score", 9)), "id"))
    most = asked.select("ask", "most")
    some = scores.select("ask", "id", rank.cast("long").alias("o"))
    within = [x.join(most, "ask").where(F.col("o") <= F.col("most")) for x in (exact, some)]
    both = within[0].unionByName(_after(within[1], 1)).select("ask", "id", "o")
    return _numbered(both, "ask").join(most, "ask").where(F.col("o") <= F.col("most")).drop("most")


def newest(nodes: DataFrame, most: int) -> DataFrame:
    """user_id, id, place of each user's ``most`` newest nodes."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("id"))).cast("long")
    return nodes.withColumn("place", place).where(F.col("place") <= most)


def _parts(asked: DataFrame, most: int) -> DataFrame:
    """query_id, user_id, part, words, most: the word searches that one question becomes."""
    q = F.col("query")
    blank = F.filter(F.split(F.translate(q, '"', " "), r"\s+"), lambda t: F.length(t) > 3)
    names = F.slice(F.filter(F.split(F.trim(q), r"\s+"), lambda t: t.rlike(r"^\p{Lu}") & (F.length(t) > 2)), 1, 4)
    phrases = F.transform(F.regexp_extract_all(q, F.lit("'[^']{3,80}'|\"[^\"]{3,80}\""), F.lit(0)), lambda t: F.trim(F.substr(t, F.lit(2), F.length(t) - 2)))
    either = F.split(q, r"(?i)\bor\b")
    long = lambda s: F.filter(F.regexp_extract_all(s, F.lit("[A-Za-z][A-Za-z0-9'-]{2,}"), F.lit(0)), lambda t: F.length(t) > 3)
    last = lambda a: F.when(F.size(a) <= 4, a).otherwise(F.slice(a, F.greatest(F.size(a) - 3, F.lit(1)), 4))
    sides = F.when(F.size(either) == 2, F.transform(either, lambda s: F.array_join(last(long(s)), " "))).otherwise(F.array().cast("array<string>"))
    part = lambda n, words, cap: F.transform(words, lambda w: F.struct(F.lit(n).alias("branch"), w.alias("words"), F.lit(cap).alias("most")))
    parts = F.concat(
        part(0, F.array(q), most),
        part(1, F.array(F.array_join(F.slice(blank, 1, 8), " ")), max(8, most // 2)),
        part(4, F.concat(names, phrases, sides), NAMED),
    )
    return asked.select("query_id", "user_id", F.posexplode(parts).alias("part", "p")).select("query_id", "user_id", "part", "p.*").where(F.trim("words") != "")


def fused(asked: DataFrame, made: Prepared, most: int = CANDIDATES, neighbours: DataFrame | None = None) -> DataFrame:
    """query_id, id, o: the shortlist of each question of ``asked`` (query_id, user_id, query).

    In order: the word search of the whole question, that of its long words, BM25 over the newest
    nodes, embedding ``neighbours`` (query_id, id, o) if there are any, then names, quoted phrases
    and the sides of an alternative. A question without any takes the newest nodes.
    """
    parts = made.scratch.cut(_parts(asked, most).withColumn("ask", F.struct("query_id", "part")))
    found = word_search(parts.select("ask", "user_id", "words", "most"), made.index).join(parts.select("ask", "branch"), "ask")
    found = found.select(F.col("ask.query_id").alias("query_id"), "id", (F.col("o") + F.col("branch") * 1_000_000 + F.col("ask.part") * 1000).alias("o"))
    docs = made.recent.where(F.col("place") <= min(RECENT, 2 * most))
    terms = asked.select("query_id", "user_id", text.lexical_tokens(F.col("query")).alias("terms"))
    ranked = ranking.best_or_first(docs, terms, "user_id", "id", "query_id", k=min(24, most)).select("query_id", "id", F.col("rank").alias("o"))
    rows = found.unionByName(_after(ranked, 2))
    if neighbours is not None:
        rows = rows.unionByName(_after(neighbours.select("query_id", "id", "o"), 3))
    spare = asked.join(docs.select("user_id", "id", F.col("place").alias("o")), "user_id").select("query_id", "id", "o")
    rows = rows.unionByName(_after(spare.where(F.col("o") <= most), 9))
    rows = rows.withColumn("least", F.min("o").over(Window.partitionBy("query_id")))
    return _numbered(rows.where("o < 9000000 OR least >= 9000000"), "query_id", most)


def timeline_sides(asked: DataFrame, memory: Memory, most: int) -> DataFrame:
    """query_id, id, o, side: dated nodes for each named event of a question, in order of time.

    Of the question's first TIMELINE rows with any token in text, label or entity, each side takes
    its share of ``most``, by token hits. A question without tokens takes the first ``most``.
    """
    return _in_time(_picked(asked, memory, most))


def _in_time(picked: DataFrame) -> DataFrame:
    """query_id, id, o, side: each node of ``_picked`` once, at its first time and side."""
    kept = picked.groupBy("query_id", "id").agg(F.min("time").alias("time"), F.min("side").cast("long").alias("side"))
    return kept.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("time")).cast("long").alias("o"), "side")


def _picked(asked: DataFrame, memory: Memory, most: int) -> DataFrame:
    """The timeline rows that each side of a question takes, with side, hits and time."""
    sides = asked.select("query_id", "user_id", text.sides(F.col("query")).alias("sides"))
    n = memory.nodes.select(F.col("id"), "content", "ts")
    rows = memory.timeline.withColumnRenamed("node_id", "id").join(n, "id").join(sides, "user_id")
    toks, time = F.flatten("sides"), F.struct("t_sort", "ts", "id")
    rows = rows.where((F.size(toks) == 0) | (text.stem_hits(toks, F.concat_ws(" ", "content", "t_label", "entity")) > 0))
    rows = ranking.top(rows.withColumn("time", time), "query_id", TIMELINE, "time").drop("rank")
    each = rows.select("query_id", "id", "time", F.size("sides").alias("n"), F.size(toks).alias("tokens"), "content", F.posexplode("sides").alias("side", "own"))
    each = each.withColumn("hits", text.stem_hits(F.col("own"), F.col("content"))).where("hits > 0 OR tokens = 0")
    place = F.row_number().over(Window.partitionBy("query_id", "side").orderBy(F.desc("hits"), "time"))
    share = F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("n")))
    return each.withColumn("place", place).where(F.col("place") <= F.when(F.col("tokens") == 0, most).otherwise(share))


def mentions(asked: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """query_id, id, o: a user's own turns that touch a question's topic, spread over the history."""
    own = nodes.where("lower(source_role) = 'user'").select("user_id", F.col("id").alias("arrival"), F.col("source_position").alias("position"), "content")
    rows = recall.spread(recall.transcript_hits(own, asked, MENTION_STOP), "query_id", most)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("position", "arrival"))
    return rows.select("query_id", F.col("arrival").alias("id"), place.cast("long").alias("o"))


def conflict_route(asked: DataFrame, memory: Memory, most: int) -> DataFrame:
    """query_id, id, o: both nodes of a question's newest conflicts, and what they supersede.

    Of a user's newest pairs those stay whose topic or bodies have the question or one of its words
    of over three letters.
    """
    pairs = ranking.top(memory.conflicts, "user_id", max(4 * most, 40), F.desc("ts"), "id").withColumnRenamed("rank", "age")
    body = lambda side: memory.nodes.select(F.col("id").alias(f"{side}_id"), F.lower("content").alias(f"{side}_body"))
    rows = pairs.join(body("a"), "a_id").join(body("b"), "b_id").join(asked.select("query_id", "user_id", F.lower(F.trim("query")).alias("q")), "user_id")
    blob = F.concat_ws(" ", "a_body", "b_body")
    word = F.exists(F.split("q", r"\s+"), lambda t: (F.length(t) > 3) & F.contains(blob, t))
    rows = rows.where(F.contains(F.lower(F.coalesce("topic", F.lit(""))), F.col("q")) | F.contains(blob, F.col("q")) | word)
    rows = ranking.top(rows, "query_id", most, "age")
    ends = rows.select("query_id", "rank", F.posexplode(F.array("a_id", "b_id")).alias("end", "id"))
    older = memory.edges.where("kind = 'supersedes'").select(F.col("src").alias("id"), "dst", "score")
    older = ranking.top(older, "id", 2, F.desc("score"), "dst").withColumnRenamed("rank", "old")
    old = ends.join(older, "id").select("query_id", F.col("dst").alias("id"), (F.col("rank") * 10 + 2 + F.col("end") * 3 + F.col("old")).cast("long").alias("o"))
    return ends.select("query_id", "id", (F.col("rank") * 10 + F.col("end")).cast("long").alias("o")).unionByName(old)


def pair_sources(asked: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, id, o: a dated source for each of the two named events of a question, if both have one."""
    best = temporal.best_events(temporal.dated_events(candidates), temporal.question_sides(asked))
    both = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    return best.join(both, "query_id", "left_semi").select("query_id", F.col("node_id").alias("id"), (F.col("side") + 1).alias("o"))


def gather(asked: DataFrame, memory: Memory, made: Prepared, most: int = CANDIDATES, widen: bool = False, seen: dict[str, DataFrame] | None = None) -> DataFrame:
    """query_id, id, o: the evidence of each question of ``asked`` (query_id, user_id, query, ability, k).

    A question is routed by its ability, and the fused shortlist always joins in; a widened pass
    also searches each named side and the distinctive words by themselves, and takes what is no
    longer current. Candidates are sorted by BM25 among themselves. Then come, while there is
    room, the neighbours one link away. ``seen`` gets what a trace shows of the pass: ``timeline``,
    ``pair_sources`` and ``retrieved``, the candidates before they are sorted.
    """
    cut = made.scratch.cut
    asked = asked.withColumn("mention", (F.col("ability") == "event_ordering") & F.col("query").rlike(text.MENTIONS))
    is_a = lambda *names: F.col("ability").isin(*names)
    past = F.lit(widen) | is_a(*text.HISTORICAL)
    facts = asked.select("query_id", "query", "ability", "k", "mention", past.alias("past"))
    shortlist = cut(fused(asked, made, most))
    node = memory.nodes.select("id", "content", "tier", "valid_to", "source_position", "source_role")
    claims = shortlist.join(asked.where(is_a("extraction", "preference")).select("query_id"), "query_id")
    claims = claims.join(node.where("tier IN ('claim', 'fact')").select("id"), "id").select("query_id", "id", "o")
    timed = asked.where(is_a("event_ordering", "temporal"))
    picked, mentioned = _picked(timed.where("NOT mention"), memory, most), mentions(timed.where("mention"), memory.nodes, most)
    if seen is not None:
        picked, mentioned = cut(picked.select("query_id", "id", "side", "hits", "time")), cut(mentioned)
        seen["timeline"] = _timeline_route(timed, picked, mentioned)
    routes = [
        conflict_route(asked.where(is_a("contradiction")), memory, 16 if widen else 8),
        _in_time(picked).drop("side"),
        mentioned,
        claims,
        _after(shortlist, 1),
    ]
    if widen:
        w = text.query_tokens(F.col("query"))
        subs = F.concat(F.transform(text.sides(F.col("query")), lambda s: F.array_join(s, " ")), F.array(F.array_join(F.slice(w, 1, 6), " ")))
        more = asked.select("query_id", "user_id", F.posexplode(F.filter(F.array_distinct(subs), lambda s: F.trim(s) != "")).alias("sub", "query"))
        extra = fused(more.select(F.struct("query_id", "sub").alias("query_id"), "user_id", "query"), made, most)
        routes.append(_after(extra.select(F.col("query_id.query_id").alias("query_id"), "id", (F.col("query_id.sub") * 1000 + F.col("o")).alias("o")), 2))
    rows = routes[0]
    for more in routes[1:]:
        rows = rows.unionByName(more)
    rows = _numbered(rows, "query_id").join(node, "id").join(facts, "query_id")
    by_user = F.lower("source_role") == "user"
    rows = rows.where((~F.col("mention") | (F.col("source_position").isNotNull() & by_user)) & (F.col("past") | F.col("valid_to").isNull()))
    rows = cut(rows.select("query_id", "id", "o", "content"))
    dated = rows.join(memory.nodes.select("id", "valid_from", "ts"), "id").join(_dates(memory), "id", "left")
    pairs = pair_sources(timed.where("NOT mention AND k >= 2"), dated.select("query_id", F.col("id").alias("node_id"), "content", *DATED))
    pairs = cut(pairs)
    candidates = _numbered(pairs.unionByName(_after(rows.drop("content"), 1)), "query_id", most)
    candidates = cut(candidates.join(memory.nodes.select("id", "lexical", "source_position"), "id"))
    if seen is not None:
        seen["pair_sources"], seen["retrieved"] = pairs, candidates.select("query_id", "id", "o")
    terms = facts.select("query_id", text.lexical_tokens(F.col("query")).alias("terms"))
    docs = candidates.select("query_id", "id", F.col("o").alias("place"), F.col("lexical").alias("terms"))
    best = ranking.best_or_first(docs, terms, "query_id", "id", "query_id", k=most).select("query_id", "id", "rank").join(facts, "query_id")
    spread = best.where("mention").join(candidates.select("query_id", "id", F.col("source_position").alias("position")), ["query_id", "id"])
    spread = recall.spread(spread, "query_id", F.col("k")).select("query_id", "id", F.col("rank").alias("o"))
    sort = best.where("NOT mention AND rank <= k").select("query_id", "id", F.col("rank").alias("o"))
    kept = _numbered(pairs.unionByName(_after(sort.unionByName(spread), 1)), "query_id").join(facts.select("query_id", "k"), "query_id").where("o <= k").drop("k")
    kept = cut(kept)
    links = ranking.top(memory.edges, "src", 5, F.desc("score"), "dst", "kind").select(F.col("src").alias("id"), "dst", "kind", F.col("rank").alias("link"))
    near = kept.join(links, "id").join(node.select(F.col("id").alias("dst"), "valid_to"), "dst").join(facts, "query_id")
    near = near.where(F.col("past") | F.col("valid_to").isNull() | (F.col("kind") == "supersedes"))
    near = _numbered(near.select("query_id", F.col("dst").alias("id"), (F.col("o") * 10 + F.col("link")).alias("o")).join(kept.select("query_id", "id"), ["query_id", "id"], "left_anti"), "query_id", min(12, most))
    near = near.join(memory.nodes.select("id", "lexical"), "id").select("query_id", "id", F.col("o").alias("place"), F.col("lexical").alias("terms"))
    near = ranking.best_or_first(near, terms, "query_id", "id", "query_id", k=most).select("query_id", "id", F.col("rank").alias("o"))
    rows = _numbered(kept.unionByName(_after(near, 1)), "query_id").join(facts, "query_id").where("o <= k").join(node, "id").where(~F.col("mention") | (F.col("source_position").isNotNull() & by_user))
    order = F.when(F.col("mention"), F.col("source_position")).otherwise(F.col("o"))
    return rows.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id")).cast("long").alias("o"))


def _dates(memory: Memory) -> DataFrame:
    """id, t_sort, t_label, t_kind: the earliest timeline event of each node."""
    first = memory.timeline.groupBy(F.col("node_id").alias("id")).agg(F.min(F.struct("t_sort", "t_label", "t_kind")).alias("e"))
    return first.select("id", "e.*")


#: Columns by which evidence is dated.
DATED = ("t_sort", "t_label", "t_kind", "valid_from", "ts")


def evidence(rows: DataFrame, memory: Memory) -> DataFrame:
    """``rows`` (query_id, id, o) as temporal.contracts takes them."""
    node = memory.nodes.select("id", "content", F.col("valid_to").isNull().alias("current"), "source_position", "source_role", "valid_from", "ts")
    rows = rows.join(node, "id").join(_dates(memory), "id", "left")
    rows = rows.withColumn("said_at", F.when(F.col("t_kind") == "absolute", F.col("t_sort")))
    known = memory.conflicts.select(F.col("a_id").alias("id"), F.col("b_id").alias("other"))
    known = known.unionByName(known.select(F.col("other").alias("id"), F.col("id").alias("other")))
    met = rows.select("query_id", "id", "o").join(known, "id").join(rows.select("query_id", F.col("id").alias("other"), F.col("o").alias("other_o")), ["query_id", "other"])
    first = met.where("o < other_o").groupBy("query_id", "id").agg(F.min_by("other", "other_o").alias("rival"))
    return rows.join(first, ["query_id", "id"], "left").select(
        "query_id", F.col("id").alias("node_id"), F.col("o").alias("rank"), "content", "said_at", "current", "rival", "source_position", "source_role", *DATED
    )


#: The abilities whose evidence must hold.
CHECKED = ("contradiction", "event_ordering", "temporal", "extraction")


def retrieve(asked: DataFrame, memory: Memory, k: int = 8, index: PostingIndex | None = None) -> DataFrame:
    """query_id, ability, widened, reason, id, rank: the evidence of each question of ``asked``
    (query_id, user_id, query), and why it doesn't hold if it doesn't.

    A question whose evidence fails its contract gets one wider pass, whose evidence counts if it
    holds. A blank question and a user without nodes get no row. With a maintained ``index`` (of
    FIELDS) of the nodes no text of theirs is tokenised but the newest and the candidates.
    """
    with Scratch(asked.sparkSession) as scratch:
        memory = _own(asked, memory, scratch)
        rows = _retrieved(asked, memory, k, prepared(memory.nodes, scratch, index))
        return written(rows, shared_dir(asked.sparkSession, "retrieved"))


def traced(asked: DataFrame, memory: Memory, k: int = 8, index: PostingIndex | None = None) -> DataFrame:
    """query_id, stage, rank, id, chars, text, limit, detail: what became of a question's evidence.

    Passages, with the characters they have and the text they show: the candidates before they are
    sorted (``retrieved``), what the first pass left of them (``gathered``), both passes together if
    there was a wider one (``widened``), the evidence in the end (``kept``) and as a reader gets it
    (``packed``). Cuts, with the ``limit`` that was passed: of a passage for the reader
    (``cut_pack``) or for the proof (``cut_prove``), and passages for which a proof has no room
    (``cut_prove_budget``). Routes, with their ``detail`` as JSON: ``route_timeline``,
    ``route_pair_sources``, both also with ``_widened``, ``route_contract_first_pass``,
    ``route_contract``, ``route_temporal``, ``route_prove_pack`` and ``route_prove``, which is what
    holds without a model. ``memory`` needs scope_session in its nodes.
    """
    with Scratch(asked.sparkSession) as scratch:
        memory = _own(asked, memory, scratch)
        seen: dict[str, DataFrame] = {}
        rows = _retrieved(asked, memory, k, prepared(memory.nodes, scratch, index), seen)
        kept = scratch.cut(rows.select("query_id", "id", F.col("rank").alias("o")))
        whole = F.coalesce("content", F.lit(""))
        node = memory.nodes.select("id", whole.alias("content"), F.length(whole).cast("long").alias("chars"))
        # three more characters around a prefix
        head = memory.nodes.select("id", (F.length(store.evidence_prefix(memory.nodes)) + 3).alias("head"))
        cost = F.col("head") + F.least("chars", F.lit(recall.PASSAGE_CUT))
        read = kept.join(node.drop("content"), "id").join(head, "id").withColumn("cost", cost.cast("long"))
        read = scratch.cut(read.withColumn("used", F.sum(F.col("cost") + BETWEEN).over(Window.partitionBy("query_id").orderBy("o")) - BETWEEN))
        stages = {name: seen[name] for name in ("retrieved", "gathered", "widened")} | {"kept": kept, "packed": kept}
        named = lambda part, name: part.select("query_id", F.lit(name).alias("stage"), F.col("o").cast("long").alias("rank"), "id")
        passages = _union([named(part, name) for name, part in stages.items()]).join(node, "id")
        shown = F.when(F.col("stage") == "packed", F.left("content", F.lit(recall.PASSAGE_CUT))).otherwise(F.left("content", F.lit(TRACE_CHARS)))
        passages = passages.withColumn("text", shown).drop("content")
        long = read.where(F.col("chars") > recall.PASSAGE_CUT)
        # a proof cuts passages up to the first that doesn't fit
        tried = F.col("used") - F.col("cost") - BETWEEN <= PROOF_CHARS
        cuts = {"cut_pack": (long, recall.PASSAGE_CUT), "cut_prove": (long.where(tried), recall.PASSAGE_CUT), "cut_prove_budget": (read.where(F.col("used") > PROOF_CHARS), PROOF_CHARS)}
        cuts = [part.select("query_id", F.lit(name).alias("stage"), F.col("o").cast("long").alias("rank"), "id", "chars", F.lit(limit).cast("long").alias("limit")) for name, (part, limit) in cuts.items()]
        routes = [part.select("query_id", F.lit(f"route_{name}").alias("stage"), "detail") for name, part in _routes(seen, kept, read, memory).items()]
        made = _union([passages, *cuts, *routes]).select("query_id", "stage", "rank", "id", "chars", "text", "limit", "detail")
        return written(made, shared_dir(asked.sparkSession, "traced"))


def _union(parts: list[DataFrame]) -> DataFrame:
    made = parts[0]
    for part in parts[1:]:
        made = made.unionByName(part, allowMissingColumns=True)
    return made


def _timeline_route(timed: DataFrame, picked: DataFrame, mentioned: DataFrame) -> DataFrame:
    """query_id, detail of each question of ``timed``: how many rows each of its named events found."""
    own = text.sides(F.col("query"))
    topic = F.transform(own, lambda s: F.filter(s, lambda t: ~t.isin(*MENTION_STOP)))
    q = timed.select("query_id", "mention", F.when(F.col("mention"), topic).otherwise(own).alias("sides"))
    found = picked.where("hits > 0").groupBy("query_id", "side").agg(F.count(F.lit(1)).alias("n"))
    found = found.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("side", "n"))).alias("by_side"))
    n = _union([picked.select("query_id", "id"), mentioned.select("query_id", "id")]).groupBy("query_id").agg(F.countDistinct("id").alias("n"))
    q = q.join(found, "query_id", "left").join(n, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    each = F.transform("sides", lambda s, i: F.coalesce(F.try_element_at("by_side", i), F.lit(0)))
    q = q.withColumn("hits", F.when(F.col("mention"), F.array("n")).otherwise(each))
    both = ~F.col("mention") & (F.size("sides") > 1) & F.forall("hits", lambda h: h > 0)
    made = F.struct(F.flatten("sides").alias("tokens"), "sides", F.col("hits").alias("side_hits"), F.col("n").alias("n_hits"), (F.col("n") == 0).alias("zero_hit"), both.alias("both_events_present"))
    return q.select("query_id", F.to_json(made).alias("detail"))


def _routes(seen: dict[str, DataFrame], kept: DataFrame, read: DataFrame, memory: Memory) -> dict[str, DataFrame]:
    """query_id, detail of each route by name."""
    as_json = lambda rows, *cols: rows.select("query_id", F.to_json(F.struct(*cols)).alias("detail"))
    ids = lambda rows, keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("o", "id")))), lambda x: x["id"])
    made = {}
    for after in ("", "_widened"):
        made[f"timeline{after}"] = seen[f"timeline{after}"]
        pairs = seen[f"pair_sources{after}"]
        made[f"pair_sources{after}"] = pairs.groupBy("query_id").agg(F.to_json(ids(pairs, F.lit(True))).alias("detail"))
    state = seen["state"].join(seen["asked"].select("query_id", F.col("query").rlike(text.MENTIONS).alias("mentions")), "query_id")
    gap, holds = F.coalesce("reason", F.lit("")), F.col("reason").isNull()
    why = F.filter(F.array("reason"), lambda x: x.isNotNull())
    first = seen["verdict"].join(state.where("widened").select("query_id"), "query_id", "left_semi")
    made["contract_first_pass"] = first.select("query_id", F.to_json(F.array("reason")).alias("detail"))
    made["contract"] = as_json(state, "ability", holds.alias("satisfied"), why.alias("reasons"), "widened")
    mention = (F.col("ability") == "event_ordering") & F.col("mentions")
    timed = seen["asked"].join(state.where(F.col("ability").isin("event_ordering", "temporal", "default", "extraction") & ~mention).select("query_id"), "query_id", "left_semi")
    made["temporal"] = _temporal_route(timed.select("query_id", "query"), temporal.dated_events(evidence(kept, memory)))
    fits = F.col("used") <= PROOF_CHARS
    pack = read.groupBy("query_id").agg(ids(read, fits).alias("included_ids"), ids(read, ~fits).alias("dropped_ids"), F.coalesce(F.max(F.when(fits, F.col("used"))), F.lit(0)).alias("chars"))
    made["prove_pack"] = as_json(pack, "included_ids", "dropped_ids", "chars", F.lit(PROOF_CHARS).alias("budget"))
    proof = state.join(kept.select("query_id", F.lit(True).alias("any")).distinct(), "query_id", "left")
    held, short = F.coalesce("any", F.lit(False)), mention & ~holds
    mode = F.when(held & ~short, "skipped").otherwise("abstain")
    reason = F.when(short, "evidence_gap").when(held, "error_open").otherwise("no_evidence")
    made["prove"] = as_json(proof, mode.alias("mode"), F.when(held, 5.0).otherwise(0.0).alias("score"), reason.alias("reason"), gap.alias("gap"))
    return made


def _temporal_route(questions: DataFrame, events: DataFrame) -> DataFrame:
    """query_id, detail: what the dated ``events`` say of the two that a question names."""
    sides = temporal.question_sides(questions)
    best = temporal.best_events(events, sides)
    e = F.struct("epoch", "kind", "node_id")
    pair = best.groupBy("query_id").agg(*[F.max(F.when(F.col("side") == n, e)).alias(name) for n, name in enumerate("ab")])
    dated = events.select("query_id").distinct().join(sides.select("query_id").distinct(), "query_id").withColumn("asked", F.lit(True))
    rows = questions.select("query_id").join(dated, "query_id", "left").join(pair, "query_id", "left")
    a, b = F.col("a"), F.col("b")
    met = a.isNotNull() & b.isNotNull()
    same = met & (a["kind"] == b["kind"])
    before = a["epoch"] <= b["epoch"]
    facts = F.struct(
        F.when(F.col("asked"), F.coalesce(same, F.lit(False))).alias("both_events_dated"),
        F.when(met & (a["kind"] != b["kind"]), F.lit(True)).alias("mixed_date_kinds"),
        F.when(same, F.when(before, a["node_id"]).otherwise(b["node_id"])).alias("earlier_id"),
        F.when(same, F.when(before, b["node_id"]).otherwise(a["node_id"])).alias("later_id"),
        F.when(same, dates.day_diff(F.least(a["epoch"], b["epoch"]), F.greatest(a["epoch"], b["epoch"]))).alias("days"),
    )
    return rows.select("query_id", F.to_json(facts).alias("detail"))


def _retrieved(asked: DataFrame, memory: Memory, k: int, made: Prepared, seen: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows of ``retrieve``; ``seen`` gets what a trace shows of them."""
    cut, late = made.scratch.cut, None if seen is None else {}
    asked = cut(asked.where(F.trim("query") != "").withColumn("ability", text.ability(F.col("query"))).withColumn("k", text.ability_k(F.col("ability"), k)))
    first = cut(gather(asked, memory, made, seen=seen))
    verdict = cut(temporal.contracts(asked.select("query_id", "query"), evidence(first, memory)))
    short = verdict.where(F.col("reason").isNotNull() & F.col("ability").isin(*CHECKED)).select("query_id")
    again = asked.join(short, "query_id", "left_semi").withColumn("k", F.least(F.col("k") + 6, F.lit(24)))
    again = cut(again)
    wide = gather(again, memory, made, 2 * CANDIDATES, True, late)
    both = _numbered(first.join(short, "query_id", "left_semi").unionByName(_after(wide, 1)), "query_id")
    both = cut(both.join(again.select("query_id", "k"), "query_id").where("o <= k").drop("k"))
    retried = temporal.contracts(again.select("query_id", "query"), evidence(both, memory)).select("query_id", F.col("reason").alias("again"), F.lit(True).alias("widened"))
    state = verdict.join(retried, "query_id", "left").select(
        "query_id", "ability", F.coalesce("widened", F.lit(False)).alias("widened"), F.when(F.col("widened"), F.col("again")).otherwise(F.col("reason")).alias("reason")
    )
    state = cut(state)
    held = state.where("widened AND reason IS NULL").select("query_id")
    rows = first.join(held, "query_id", "left_anti").unionByName(both.join(held, "query_id", "left_semi"))
    rows = rows.join(state, "query_id").select("query_id", "ability", "widened", "reason", "id", F.col("o").alias("rank"))
    if seen is not None:
        seen |= {f"{name}_widened": late[name] for name in ("timeline", "pair_sources")}
        seen |= {"gathered": first, "widened": both, "asked": asked, "verdict": verdict, "state": state}
    return rows
