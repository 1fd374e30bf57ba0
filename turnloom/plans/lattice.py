"""Queries of dated evidence, contracts and the routed retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.functions import text
from turnloom.operators import recall, retrieval, scoring, store, temporal
from turnloom.plans import views as v
from turnloom.plans.catalog import query
from turnloom.plans.dates import mentions
from turnloom.plans.memory import profile_build
from turnloom.plans.search import _turn_ranks
from turnloom.sources.shared import Scratch, shared_dir, written


def memory(spark, sf_dir):
    """The relations of the store that the retrieval runs on."""
    return retrieval.Memory(*(relation(spark, sf_dir) for relation in (v.nodes, v.timeline, v.conflicts, v.edges)))


def _evidence(spark, sf_dir, k=16):
    """A query's best turns as evidence rows."""
    ranked = _turn_ranks(spark, sf_dir, k).select("query_id", F.col("arrival").alias("id"), F.col("rank").alias("o"))
    return retrieval.evidence(ranked, memory(spark, sf_dir))


def _sided(spark, sf_dir):
    """Every query as a comparison of its first three and its next three words."""
    w = F.split("query", " ")
    q = F.concat_ws(" ", F.lit("how long between"), F.array_join(F.slice(w, 1, 3), " "), F.lit("and"), F.array_join(F.slice(w, 4, 3), " "))
    return v.queries(spark, sf_dir).select("query_id", "user_id", q.alias("query"))


@query("dated_events")
def dated_events(spark, sf_dir):
    return temporal.dated_events(_evidence(spark, sf_dir))


@query("temporal_pair")
def temporal_pair(spark, sf_dir):
    events = temporal.dated_events(_evidence(spark, sf_dir))
    return temporal.best_events(events, temporal.question_sides(_sided(spark, sf_dir))).select("query_id", "side", "node_id", "epoch", "kind", "hits")


@query("compute_temporal")
def compute_temporal(spark, sf_dir):
    events = temporal.dated_events(_evidence(spark, sf_dir))
    return temporal.compared(temporal.best_events(events, temporal.question_sides(_sided(spark, sf_dir))))


def _since(spark, sf_dir):
    """Every query as a question of time on the last day of 2024: how long ago one thing was, or how
    far apart two are."""
    w = F.split("query", " ")
    two = F.concat(F.lit("How many days between "), F.array_join(F.slice(w, 1, 3), " "), F.lit(" and "), F.array_join(F.slice(w, 4, 3), " "), F.lit("?"))
    one = F.concat(F.lit("How many days ago was "), F.array_join(F.slice(w, 1, 3), " "), F.lit("?"))
    asked = F.when(F.expr("query_id div 100 % 2") == 0, one).otherwise(two)
    return v.queries(spark, sf_dir).select("query_id", asked.alias("query"), F.lit(1735603200.0).alias("as_of"))


@query("elapsed_events")
def elapsed_events(spark, sf_dir):
    """How long ago what a question names was, by its best turns."""
    return temporal.elapsed(_since(spark, sf_dir), temporal.dated_events(_evidence(spark, sf_dir)))


@query("computed_lines")
def computed_lines(spark, sf_dir):
    """What the dates of a question's best turns say to it."""
    rows = temporal.computed_lines(_since(spark, sf_dir), temporal.dated_events(_evidence(spark, sf_dir)))
    return rows.select("query_id", F.array_join("lines", "\n").alias("lines"))


def hits_scorer(asked):
    """A scorer without a model: twice the question's tokens that a passage has, none for long questions."""
    toks = text.query_tokens(F.col("query"))
    return asked.where(F.size(toks) <= 6).select("query_id", "id", (2.0 * text.stem_hits(toks, F.col("content"))).alias("score"))


@query("usefulness_scored")
def usefulness_scored(spark, sf_dir):
    """A question's 60 best turns sorted by a scorer that is plugged in."""
    found = _turn_ranks(spark, sf_dir, 60).select("query_id", F.col("arrival").alias("id"), F.col("rank").alias("place"))
    rows = found.join(v.nodes(spark, sf_dir).select("id", "content"), "id")
    return scoring.by_usefulness(rows, v.queries(spark, sf_dir).select("query_id", "query"), hits_scorer)


@query("memory_blocks")
def memory_blocks(spark, sf_dir):
    """The blocks of evidence for every question of time: its best turns, its user's profile, what the
    dates say, withheld where every other question's evidence breaks its contract."""
    asked = _since(spark, sf_dir)
    with Scratch(spark) as scratch:
        evidence = scratch.cut(_evidence(spark, sf_dir, 8))
        verdict = scratch.cut(temporal.contracts(asked, evidence))
        proves = F.when(F.expr("query_id div 100 % 3") > 0, F.col("reason").isNull())
        node = v.nodes(spark, sf_dir)
        prefix = node.select(F.col("id").alias("node_id"), store.evidence_prefix(node).alias("prefix"))
        passages = evidence.join(prefix, "node_id").select("query_id", "rank", "prefix", "content")
        mine = v.queries(spark, sf_dir).select("query_id", F.col("user_id").alias("scope_key")).join(profile_build(spark, sf_dir), "scope_key")
        lines = scratch.cut(temporal.computed_lines(asked, temporal.dated_events(evidence)))
        rows = recall.memory_blocks(verdict.select("query_id", "ability", proves.alias("proves")), passages, mine.select("query_id", F.lit(1).alias("rank"), "content"), lines)
        return written(rows, shared_dir(spark, "blocks"))


def _asked(spark, sf_dir):
    head = F.expr("CASE query_id div 100 % 4 WHEN 0 THEN 'When was ' WHEN 1 THEN 'What is ' WHEN 2 THEN 'You said ' ELSE '' END")
    return v.queries(spark, sf_dir).select("query_id", F.concat(head, "query").alias("query"))


@query("contract_check")
def contract_check(spark, sf_dir):
    return temporal.contracts(_asked(spark, sf_dir), _evidence(spark, sf_dir))


@query("gap_fact")
def gap_fact(spark, sf_dir):
    """Gaps from the notes of a day's phrases: one question over each of the calendar's days."""
    n = v.notes(spark, sf_dir).withColumn("day", F.expr("said_at div 86400"))
    q = n.select(F.col("day").alias("query_id")).distinct().withColumn("query", F.lit("How many days between the Garden show and met Anna?"))
    first = n.groupBy("day", "body").agg(F.min("note_id").alias("note_id"), F.min("said_at").alias("said_at"))
    m = mentions(first).join(first.select("note_id", F.col("day").alias("query_id")), "note_id").select("query_id", "clause", "epoch")
    c = first.select(F.col("day").alias("query_id"), F.explode(text.clauses(F.col("body"))).alias("clause"))
    return temporal.gap_facts(q, m, c)


@query("char_chunks")
def char_chunks(spark, sf_dir):
    """Every whole document in chunks of 1,000 characters."""
    return temporal.char_chunks(v.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 1000)


def _questions(spark, sf_dir):
    """Queries of all abilities over whole histories: the first words of a turn in turn as each form."""
    w = F.split("query", " ")
    words = lambda at, n: F.array_join(F.slice(w, at, n), " ")
    form = F.expr("query_id div 100 % 8")
    made = (
        F.when(form == 0, F.concat(F.lit("When was "), "query"))
        .when(form == 1, F.concat(F.lit("What is "), "query"))
        .when(form == 2, F.concat(F.lit("You said "), "query"))
        .when(form == 3, F.concat(F.lit("List the order of two things I mentioned about "), "query"))
        .when(form == 4, F.concat(F.lit("How many days between "), words(1, 3), F.lit(" and "), words(4, 3), F.lit("?")))
        .when(form == 5, F.concat(F.lit("Do I prefer "), words(1, 3), F.lit(" or "), words(4, 3)))
        .when(form == 6, F.concat(F.lit("Say more on '"), words(1, 2), F.lit("' from "), F.initcap(words(3, 2))))
        .otherwise(F.col("query"))
    )
    return v.queries(spark, sf_dir).select("query_id", "user_id", made.alias("query"))


@query("fusion_shortlist_whole")
@query("fusion_candidates")
def fusion_candidates(spark, sf_dir):
    """The shortlist of all word, recency, name, phrase and alternative branches for every question."""
    with Scratch(spark) as scratch:
        rows = retrieval.fused(_questions(spark, sf_dir), retrieval.prepared(scratch.cut(v.nodes(spark, sf_dir)), scratch))
        return written(rows.select("query_id", F.col("id").alias("node_id"), F.col("o").alias("rank")), shared_dir(spark, "shortlist"))


@query("timeline_sides")
def timeline_sides(spark, sf_dir):
    """Dated nodes for each named event of every question, in order of time."""
    rows = retrieval.timeline_sides(_questions(spark, sf_dir), memory(spark, sf_dir), 12)
    return rows.select("query_id", F.col("id").alias("node_id"), F.col("o").alias("rank"), "side")


@query("retrieve_routed")
def retrieve_routed(spark, sf_dir):
    """The routed retrieval whole: gathered by ability, checked, widened once."""
    rows = retrieval.retrieve(_questions(spark, sf_dir), memory(spark, sf_dir))
    return rows.select("query_id", "ability", "widened", "reason", F.col("id").alias("node_id"), "rank")


@query("stage_trace")
def stage_trace(spark, sf_dir):
    """What each stage of the routed retrieval had for every question, what was cut and by which routes
    it went, in long form."""
    return retrieval.traced(_questions(spark, sf_dir), memory(spark, sf_dir)).withColumnRenamed("id", "node_id")
