"""Dated evidence: pairing, ordering and gaps of two events, contracts, and the retrieval that
routes, gathers and checks for many queries in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import dates, text


def _with_dates(evidence: DataFrame) -> DataFrame:
    """``evidence`` with the columns by which it is dated; said_at alone is an absolute event."""
    if "t_kind" in evidence.columns:
        return evidence
    none = {c: F.lit(None).cast(k) for c, k in (("t_label", "string"), ("valid_from", "double"), ("ts", "double"))}
    return evidence.withColumns({"t_kind": F.when(F.col("said_at").isNotNull(), "absolute"), "t_sort": F.col("said_at").cast("double"), **none})


def _explicit():
    return F.when(F.abs(F.col("valid_from") - F.coalesce("ts", F.lit(0.0))) > 1.0, F.col("valid_from"))


def dated_events(evidence: DataFrame) -> DataFrame:
    """query_id, node_id, event, epoch, kind, label of ``evidence`` (query_id, node_id, content).

    A node is dated by its earliest timeline event (t_sort, t_kind, t_label) or, if that is no date,
    by a valid_from that differs from ts by more than a second; evidence with ``said_at`` alone has
    absolute events. A relative event is the node's own (kind ``event``), any other date only says
    when it was told (``session``). From a told date, or from an explicit valid_from without any
    timeline event, every sentence of twelve or more characters with a relative phrase names one
    more event.
    """
    rows, explicit = _with_dates(evidence), _explicit()
    dated = F.col("t_kind").isin("absolute", "relative")
    rows = rows.select(
        "query_id", "node_id", "content",
        F.when(F.col("t_kind") == "absolute", F.col("t_sort")).when(F.col("t_kind").isNull(), explicit).alias("anchor"),
        F.when(dated, F.col("t_sort")).otherwise(explicit).cast("double").alias("epoch"),
        F.when(F.col("t_kind") == "relative", "event").otherwise("session").alias("kind"), F.when(dated, F.col("t_label")).alias("label"),
    )
    s = rows.where("anchor IS NOT NULL").select("query_id", "node_id", "anchor", F.explode(text.sentences(F.col("content"))).alias("event"))
    s = s.where((F.length("event") >= 12) & F.col("event").rlike(dates.RELATIVE))
    s = s.select("query_id", "node_id", "event", text.once(dates.parse_relative(F.col("event"), F.col("anchor"))).alias("t"))
    own = s.where("t IS NOT NULL").select("query_id", "node_id", "event", F.col("t.epoch").alias("epoch"), F.lit("event").alias("kind"), F.col("t.label").alias("label"))
    told = rows.where("epoch IS NOT NULL").select("query_id", "node_id", F.col("content").alias("event"), "epoch", "kind", "label")
    return own.unionByName(told)


def best_events(events: DataFrame, sides: DataFrame) -> DataFrame:
    """query_id, side, node_id, event, epoch, kind, label: the event that fits each side of a query best.

    ``sides`` has query_id, side, tokens and rivals. An event must match its side more than the
    other; then more hits, a named event before a session date, and the shorter text win. The
    node of side 0 is left out when side 1 is looked for. A side without ``rivals`` (null) stands
    alone: there an event must have half of its tokens. A query's events are few.
    """
    # stems are taken of a question's sides, not of them for each event
    sides = sides.select("*", text.once(F.struct(*(F.transform(c, text.stem).alias(c) for c in ("tokens", "rivals")))).alias("stems"))
    rows = events.join(sides, "query_id")
    hits, rival = (text.stems_in(F.col(f"stems.{c}"), F.col("event")) for c in ("tokens", "rivals"))
    made = F.struct(hits.alias("hits"), F.coalesce(rival, F.lit(0)).alias("rival"))
    rows = rows.select(*events.columns, "side", "tokens", "rivals", text.once(made).alias("made"))
    rows = rows.select(*events.columns, "side", "tokens", "rivals", "made.*")
    need = F.when(F.col("rivals").isNull(), F.greatest(F.lit(1), F.floor((F.size("tokens") + 1) / 2))).otherwise(1)
    rows = rows.where((F.col("hits") >= need) & (F.col("rivals").isNull() | (F.col("hits") > F.col("rival"))))
    order = (F.desc(F.col("hits") - F.col("rival")), F.desc("hits"), F.desc(F.col("kind") == "event"), F.length("event"), "node_id", "event")
    rank = F.row_number().over(Window.partitionBy("query_id", "side").orderBy(*order))
    first = F.max(F.when((F.col("side") == 0) & (F.col("rank") == 1), F.col("node_id"))).over(Window.partitionBy("query_id"))
    rows = rows.withColumn("rank", rank).withColumn("first", first).where((F.col("side") == 0) | F.col("first").isNull() | (F.col("node_id") != F.col("first")))
    return rows.withColumn("rank", rank).where("rank = 1").drop("rank", "first", "tokens", "rivals", "rival")


#: A question about how long ago something was.
AGO = r"(?i)\bhow\s+(?:many|long)\b.*\bago\b"
AGO_FRAME = r"(?i)\bhow\s+(?:many|long)\b.*?\bago\b"


def elapsed(questions: DataFrame, events: DataFrame) -> DataFrame:
    """query_id, node_id, event, epoch, kind, label, as_of, days, gap of the ``questions`` (query_id,
    query, as_of) that ask how long ago one event was; not later than ``as_of``, which may be null."""
    alone = questions.where(F.col("as_of").isNotNull() & F.col("query").rlike(AGO)).join(question_sides(questions).select("query_id").distinct(), "query_id", "left_anti")
    tokens = text.query_tokens(F.regexp_replace("query", AGO_FRAME, " "))
    sides = alone.select("query_id", F.lit(0).cast("long").alias("side"), tokens.alias("tokens"), F.lit(None).cast("array<string>").alias("rivals"))
    best = best_events(events, sides.where(F.size("tokens") > 0)).drop("side", "hits").join(alone.select("query_id", F.col("as_of").cast("double").alias("as_of")), "query_id")
    at = (F.col("epoch"), F.col("as_of"))
    return best.where("epoch <= as_of").withColumns({"days": dates.day_diff(*at), "gap": dates.describe_gap(*at)})


def _day(epoch):
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd")


def _tag(e):
    """Fixed forms: the date of an event and what kind of date it is."""
    own = F.concat(F.lit(', event date resolved from "'), F.coalesce(e["label"], F.lit("None")), F.lit('"'))
    return F.concat(_day(e["epoch"]), F.when(e["kind"] == "event", own).otherwise(", session/mention date (not necessarily the event date)"))


def computed_lines(questions: DataFrame, events: DataFrame) -> DataFrame:
    """query_id, lines: what the dates of ``events`` say to a question (query_id, query, as_of): which of
    two named events came first and how far apart they are, or how long ago one was."""
    best = best_events(events, question_sides(questions))
    e = F.struct("epoch", "event", "kind", "label")
    pair = best.groupBy("query_id").agg(F.max(F.when(F.col("side") == 0, e)).alias("a"), F.max(F.when(F.col("side") == 1, e)).alias("b"))
    pair = pair.where("a IS NOT NULL AND b IS NOT NULL")
    a, b = F.col("a"), F.col("b")
    named = lambda n, x: F.concat(F.lit(f'Event {n} "'), text.clipped(x["event"], 90), F.lit('" ['), _tag(x), F.lit("]"))
    both = F.concat(named("A", a), F.lit("; "), named("B", b), F.lit("."))
    mixed = F.concat(both, F.lit(" One is an event date and the other only a session date, so their order is NOT determined by these dates; reason from the evidence text."))
    lo, hi = F.least(a["epoch"], b["epoch"]), F.greatest(a["epoch"], b["epoch"])
    earlier = F.concat(F.lit("Event "), F.when(a["epoch"] <= b["epoch"], "A").otherwise("B"), F.lit(" is EARLIER. Gap: "), dates.describe_gap(lo, hi), F.lit("."))
    order = F.when(dates.day_diff(lo, hi) == 0, "A and B fall on the same date; order is not determined by dates.").otherwise(earlier)
    lines = F.when(a["kind"] != b["kind"], F.array(mixed)).otherwise(F.array(both, order))
    one = elapsed(questions, events)
    x = F.struct("epoch", "event", "kind", "label")
    since = F.concat(F.lit('Event "'), text.clipped(F.col("event"), 90), F.lit('" ['), _tag(x), F.lit("] was "), F.col("gap"), F.lit(" before the question date "), _day(F.col("as_of")), F.lit("."))
    return pair.select("query_id", lines.alias("lines")).unionByName(one.select("query_id", F.array(since).alias("lines")))


def compared(best: DataFrame) -> DataFrame:
    """query_id, comparable, first_side, gap of the queries that have an event on both sides.

    A named event and a session date aren't comparable: the session only says when it was told.
    """
    e = F.struct("epoch", "kind")
    pair = best.groupBy("query_id").agg(F.max(F.when(F.col("side") == 0, e)).alias("a"), F.max(F.when(F.col("side") == 1, e)).alias("b"))
    pair = pair.where("a IS NOT NULL AND b IS NOT NULL")
    a, b = F.col("a.epoch"), F.col("b.epoch")
    same = F.col("a.kind") == F.col("b.kind")
    return pair.select(
        "query_id",
        same.alias("comparable"),
        F.when(same, F.when(a == b, -1).when(a < b, 0).otherwise(1)).alias("first_side"),
        F.when(same, dates.describe_gap(F.least(a, b), F.greatest(a, b))).alias("gap"),
    )


#: Fixed value: two events whose names may begin with an article.
LOOSE = r"(?id)between\s+(?:the\s+)?(.+?)\s+and\s+(?:the\s+)?(.+?)\s*(?:\?|$)"


def question_sides(questions: DataFrame) -> DataFrame:
    """query_id, side, tokens, rivals of the ``questions`` (query_id, query) that name two events."""
    loose = F.array(*[text.query_tokens(F.regexp_extract("query", LOOSE, k)) for k in (1, 2)])
    s = questions.select("query_id", text.once(F.struct(text.sides(F.col("query")).alias("s"), loose.alias("l"))).alias("made"))
    s = s.select("query_id", "made.*").select("query_id", F.when(F.size("s") == 2, F.col("s")).when(F.forall("l", lambda x: F.size(x) > 0), F.col("l")).alias("s")).where(F.size("s") == 2)
    rows = s.select("query_id", "s", F.posexplode("s").alias("side", "tokens"))
    return rows.select("query_id", F.col("side").cast("long").alias("side"), "tokens", F.element_at("s", F.when(F.col("side") == 0, 2).otherwise(1)).alias("rivals"))


def contracts(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, ability, reason of each query; a null reason means the contract holds.

    ``queries`` has query_id and query, ``evidence`` query_id, node_id, rank, content, said_at,
    current, rival (the first later node that it conflicts with), source_position and source_role.
    A contradiction needs two conflicting nodes, or a superseded and a current one, both dated. An
    order of mentions needs as many of the user's own turns as asked for, two named events need
    comparable dates on both sides, and other questions of time two dated events.
    """
    q = F.col("query")
    facts = F.struct(
        text.ability(q).alias("ability"),
        text.query_tokens(q).alias("toks"),
        q.rlike(text.MENTIONS).alias("mention"),
        F.coalesce(text.requested_length(q), F.lit(2)).alias("wanted"),
        (F.size(text.sides(q)) == 2).alias("sided"),
    )
    facts = queries.select("query_id", text.once(facts).alias("facts")).select("query_id", "facts.*")
    e = _with_dates(evidence).join(facts, "query_id")
    known = F.coalesce(F.col("t_kind").isin("absolute", "relative"), F.lit(False)) | _explicit().isNotNull()
    toks = F.slice("toks", 1, 6)
    need = F.greatest(F.lit(1), F.ceil(F.size(toks) * 0.6))
    first = lambda value, keep: F.min_by(value, F.when(keep, F.col("rank")))
    rivals = F.col("rival").isNotNull()
    spans = (F.col("ability") == "extraction") & (F.size("toks") > 0)  # no other question is asked for them
    claim = F.when(
        (F.lower("source_role") == "user") & F.col("source_position").isNotNull(),
        F.struct("source_position", F.trim(F.regexp_replace(F.lower("content"), r"\s+", " "))),
    )
    held = e.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.collect_set(F.when(known, F.col("node_id"))).alias("dated"),  # of one query's evidence
        first("node_id", rivals).alias("a"),
        first("rival", rivals).alias("b"),
        first("node_id", ~F.col("current")).alias("old"),
        first("node_id", F.col("current")).alias("new"),
        F.countDistinct(claim).alias("claims"),
        F.bool_or(F.when(spans, text.densest_hits(F.left("content", F.lit(2000)), toks) >= need)).alias("found"),
        F.bool_or(F.when(spans, text.densest_hits(F.col("content"), toks) >= need)).alias("found_beyond"),
    )
    events = dated_events(evidence)
    n_events = events.groupBy("query_id").agg(F.count(F.lit(1)).alias("events"))
    both = compared(best_events(events, question_sides(queries))).select("query_id", "comparable")
    rows = facts.join(held, "query_id", "left").join(n_events, "query_id", "left").join(both, "query_id", "left")
    of = lambda *names: F.col("ability").isin(*names)
    clash, replaced = F.col("a").isNotNull(), F.col("old").isNotNull() & F.col("new").isNotNull()
    dated = lambda x, y: F.array_contains("dated", F.col(x)) & F.array_contains("dated", F.col(y))
    order = of("event_ordering", "temporal")
    reason = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "empty_pack")
        .when(of("contradiction") & ~clash & ~replaced, "cr_missing_second_claim")
        .when(of("contradiction") & ~F.when(clash, dated("a", "b")).otherwise(dated("old", "new")), "cr_claims_undated")
        .when(order & F.col("mention"), F.when(F.col("claims") < F.col("wanted"), "eo_not_enough_ordered_events"))
        .when(order & F.col("sided"), F.when(~F.coalesce("comparable", F.lit(False)), "eo_named_events_not_both_dated"))
        .when(order & (F.coalesce("events", F.lit(0)) < 2), "eo_fewer_than_two_dated_events")
        .when(of("extraction") & (F.size("toks") > 0) & ~F.col("found"), F.when(F.col("found_beyond"), "ie_span_beyond_evidence_cap").otherwise("ie_span_missing"))
    )
    return rows.select("query_id", "ability", reason.alias("reason"))


def gap_facts(questions: DataFrame, mentions: DataFrame, clauses: DataFrame) -> DataFrame:
    """query_id, first, second, gap for "how long between A and B" questions, if both are clear.

    ``questions`` has query_id and query, ``mentions`` query_id, clause, epoch, and ``clauses``
    query_id, clause. A rarer word weighs more. A side's clause needs two hits, positive weight,
    half the side's words, a word that hardly any other clause has, and no rival date near it.
    """
    asks = F.col("query").rlike(r"(?i)\bhow\s+(?:many\s+(?:days?|weeks?|months?|years?)|long)\b")
    q = questions.where(asks).select("query_id", text.sides(F.col("query")).alias("s")).where(F.size("s") == 2)
    sides = q.select("query_id", F.posexplode("s").alias("side", "tokens")).join(q, "query_id")
    sides = sides.select("query_id", F.col("side").cast("long").alias("side"), "tokens", F.element_at("s", F.when(F.col("side") == 0, 2).otherwise(1)).alias("rivals"))
    words = sides.select("query_id", F.explode("tokens").alias("w")).distinct()
    total = clauses.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    held = words.join(clauses, "query_id").where(F.contains(F.lower("clause"), text.stem(F.col("w"))))
    df = held.groupBy("query_id", "w").agg(F.count(F.lit(1)).alias("df"))
    weight = words.join(total, "query_id").join(df, ["query_id", "w"], "left")
    weight = weight.select("query_id", "w", "n", F.log(1 + F.col("n") / F.greatest(F.lit(1), F.coalesce("df", F.lit(0)))).alias("weight"), F.coalesce("df", F.lit(0)).alias("df"))
    m = mentions.distinct()
    own = sides.select("query_id", "side", F.explode("tokens").alias("w"), F.lit(1).alias("sign"), F.size("tokens").alias("size"))
    other = sides.select("query_id", "side", F.explode(F.array_except("rivals", "tokens")).alias("w"), F.lit(-1).alias("sign"), F.size("tokens").alias("size"))
    met = own.unionByName(other).join(weight, ["query_id", "w"]).join(m, "query_id")
    met = met.where(F.contains(F.lower("clause"), text.stem(F.col("w"))))
    here = m.join(held.select("query_id", "w", "clause").distinct(), ["query_id", "clause"]).groupBy("query_id", "epoch", "w").agg(F.countDistinct("clause").alias("own_df"))
    met = met.join(here, ["query_id", "epoch", "w"], "left")
    rare = (F.col("sign") == 1) & (F.col("df") - F.coalesce("own_df", F.lit(0)) <= F.floor(F.col("n") / 20))
    scored = met.groupBy("query_id", "side", "clause", "epoch", "size").agg(
        F.round(F.sum(F.col("sign") * F.col("weight")), 9).alias("score"), F.count_if(F.col("sign") == 1).alias("hits"), F.bool_or(rare).alias("rare")
    )
    w = Window.partitionBy("query_id", "side")
    ranked = scored.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), F.desc("hits"), "epoch", "clause")))
    best = F.max(F.when(F.col("rank") == 1, F.col("epoch"))).over(w)
    rivals = ranked.withColumn("rival", F.max(F.when(F.col("epoch") != best, F.col("score"))).over(w))
    clear = (F.col("hits") >= 2) & (F.col("score") > 0) & F.col("rare") & (F.col("hits") >= 0.5 * F.col("size"))
    clear &= F.coalesce(F.col("rival") < 0.85 * F.col("score"), F.lit(True))
    kept = rivals.where((F.col("rank") == 1) & clear)
    side = lambda k: F.max(F.when(F.col("side") == k, F.struct("epoch", "clause")))
    pair = kept.groupBy("query_id").agg(side(0).alias("a"), side(1).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    a, b = F.col("a.epoch"), F.col("b.epoch")
    return pair.select("query_id", text.clipped(F.col("a.clause"), 110).alias("first"), text.clipped(F.col("b.clause"), 110).alias("second"), dates.span(F.least(a, b), F.greatest(a, b)).alias("gap"))


def char_chunks(texts: DataFrame, key: str, column: str, most: int) -> DataFrame:
    """key, chunk, piece: texts cut to ``most`` characters, back to the last blank past the half.

    Where a piece ends depends on the last, so each text is scanned once from its start: what is
    left if it fits, else up to the last blank past the half, else ``most`` characters.
    """
    half = most // 2 + 1
    blank = f"|.{{{half},{most - 1}}}(?= )" if half < most else ""
    pieces = F.regexp_extract_all(column, F.lit(f"(?s).{{1,{most}}}+\\z{blank}|.{{1,{most}}}"), F.lit(0))
    kept = F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: p != "")
    return texts.where(F.col(column).isNotNull()).select(key, F.posexplode(kept).alias("chunk", "piece"))
