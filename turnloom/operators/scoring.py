"""Sorting by scores that an outside scorer gives, with what holds where it gives none.

A scorer is a function from a frame (query_id, batch, id, query, content) to one with query_id, id
and score, for the rows that it could score; a row it leaves out has failed. It sees each question's
best candidates only, in batches, and none that a table of known scores (query_id, id, score) has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import text
from turnloom.operators import ranking
from turnloom.sources.shared import Scratch, shared_dir, written

#: Candidates that are scored, those of one batch, the scale of usefulness and of proofs,
#: and the score from which a proof holds.
SCORED, BATCH, MOST, PROOF, FLOOR = 48, 8, 10.0, 9.0, 4.0

Scorer = Callable[[DataFrame], DataFrame]


def clamped(score: Column, most: float) -> Column:
    return F.when(score.isNotNull(), F.least(F.lit(most), F.greatest(F.lit(0.0), score.cast("double"))))


def _latest(scores: DataFrame) -> DataFrame:
    return scores.where("score IS NOT NULL AND NOT isnan(score)").groupBy("query_id", "id").agg(F.max("score").alias("score"))


def _scores(asked: DataFrame, scorer: Scorer) -> DataFrame:
    """The scores of the rows of ``asked``; what a first call leaves out is asked for once more, each
    row as a batch of its own."""
    first = asked.select("query_id", "batch", "id").join(_latest(scorer(asked)), ["query_id", "id"], "left")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("batch", "id"))
    failed = first.where("score IS NULL").select("query_id", "id", (place + SCORED).cast("long").alias("batch"))
    failed = failed.join(asked.drop("batch"), ["query_id", "id"]).select(*asked.columns)
    again = _latest(scorer(failed)).withColumnRenamed("score", "second")
    return first.join(again, ["query_id", "id"], "left").select("query_id", "id", F.coalesce("score", "second").alias("score"))


def by_usefulness(candidates: DataFrame, questions: DataFrame, scorer: Scorer, k: int = 8, known: DataFrame | None = None) -> DataFrame:
    """query_id, id, rank, score, mode: the ``k`` most useful ``candidates`` (query_id, id, place, content)
    of each of the ``questions`` (query_id, query).

    The SCORED best by BM25 are scored, in batches of BATCH; a batch's failures are tried again one
    by one, and what still fails is left out. Candidates behind them count 0 (mode ``scored``). Ties
    keep the order: newly scored, known, not scored. A question for which nothing could be scored
    is sorted by words alone (mode ``keyword``). New scores can be read from ``scored``.
    """
    with Scratch(candidates.sparkSession) as scratch:
        asked, rows = _prepared(candidates, questions, known, scratch)
        new = scratch.cut(_scores(asked, scorer))
        made = rows.join(new.withColumnRenamed("score", "fresh"), ["query_id", "id"], "left")
        value = F.when(F.col("known").isNotNull(), clamped(F.col("known"), MOST)).when(F.col("pre") > SCORED, 0.0).otherwise(clamped(F.col("fresh"), MOST))
        group = F.when(F.col("known").isNotNull(), 1).when(F.col("pre") > SCORED, 2).otherwise(0)
        order = F.when(group == 2, F.col("place")).otherwise(F.col("pre"))
        made = made.withColumns({"score": value, "group": group, "at": order})
        any_ = F.max(F.when(F.col("group") < 2, F.col("score"))).over(Window.partitionBy("query_id")).isNotNull()
        made = scratch.cut(made.withColumn("any", any_))
        good = ranking.top(made.where("any AND score IS NOT NULL"), "query_id", k, F.desc("score"), "group", "at", "id")
        words = made.where("NOT any").withColumn("best", F.max("lexical").over(Window.partitionBy("query_id")))
        words = words.where((F.col("best") <= 0) | (F.col("lexical") >= 0.5 * F.col("best")))
        # without a hit the candidates stand in their own order
        words = ranking.top(words, "query_id", k, F.desc(F.greatest("lexical", F.lit(0.0))), "place", "id")
        columns = lambda df, score, mode: df.select("query_id", "id", "rank", score.alias("score"), F.lit(mode).alias("mode"))
        both = columns(good, F.col("score"), "scored").unionByName(columns(words, F.lit(None).cast("double"), "keyword"))
        return written(both, shared_dir(candidates.sparkSession, "useful"))


def scored(candidates: DataFrame, questions: DataFrame, scorer: Scorer, known: DataFrame | None = None) -> DataFrame:
    """query_id, id, score: ``known`` and what the scorer adds to it, for a later call of the same questions."""
    with Scratch(candidates.sparkSession) as scratch:
        asked, _ = _prepared(candidates, questions, known, scratch)
        new = _scores(asked, scorer).where("score IS NOT NULL").select("query_id", "id", clamped(F.col("score"), MOST).alias("score"))
        both = new if known is None else new.unionByName(_latest(known).select("query_id", "id", F.col("score").cast("double")))
        return written(both, shared_dir(candidates.sparkSession, "scores"))


def _prepared(candidates: DataFrame, questions: DataFrame, known: DataFrame | None, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """What is to be asked, and every candidate with pre (its place by BM25), lexical and known."""
    # texts are dealt out by question once, and kept with no more of their words than it asks for
    own = candidates.repartition("query_id").groupBy("query_id", "id").agg(F.min("place").alias("place"), F.max("content").alias("content"))
    words = questions.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list(text.lexical_tokens(F.col("query"))))).alias("words"))
    own = own.join(words, "query_id").withColumn("terms", text.lexical_tokens(F.col("content")))
    own = scratch.cut(own.select("query_id", "id", "place", "content", F.size("terms").alias("size"), F.filter("terms", lambda t: F.array_contains("words", t)).alias("terms")))
    docs = own.select(F.col("query_id").alias("within"), "id", "terms", "size")
    terms = questions.select("query_id", F.col("query_id").alias("within"), text.lexical_tokens(F.col("query")).alias("terms"))
    found = ranking.bm25(docs, terms, "within", "id", "query_id", least_length=1).withColumn("lexical", F.round("score", 9)).drop("score")
    rows = own.select("query_id", "id", "place").join(found, ["query_id", "id"], "left").withColumn("lexical", F.coalesce("lexical", F.lit(0.0)))
    pre = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lexical"), "place", "id"))
    rows = rows.withColumn("pre", pre.cast("long"))
    held = F.lit(None).cast("double")
    if known is not None:
        rows, held = rows.join(_latest(known).withColumnRenamed("score", "held"), ["query_id", "id"], "left"), F.col("held").cast("double")
    rows = scratch.cut(rows.withColumn("known", F.when(F.col("pre") <= SCORED, held)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("pre")) - 1
    new = rows.where((F.col("pre") <= SCORED) & F.col("known").isNull()).withColumn("batch", F.floor(place / BATCH).cast("long"))
    asked = new.join(questions.select("query_id", "query"), "query_id").join(own.select("query_id", "id", "content"), ["query_id", "id"])
    asked = asked.select("query_id", "batch", "id", "query", "content")
    return scratch.cut(asked), rows


def proofs(questions: DataFrame, scores: DataFrame) -> DataFrame:
    """query_id, proves, score, mode of the ``questions`` (query_id, gaps) by given ``scores`` (query_id,
    score): a proof holds from FLOOR on, one more where there are gaps. Without a score it holds
    (mode ``skipped``)."""
    rows = questions.join(scores.groupBy("query_id").agg(F.max("score").alias("score")), "query_id", "left")
    score = clamped(F.col("score"), PROOF)
    holds = score >= FLOOR + F.coalesce(F.col("gaps"), F.lit(False)).cast("int")
    mode = F.when(F.col("score").isNull(), "skipped").when(holds, "prove").otherwise("abstain")
    return rows.select("query_id", F.coalesce(holds, F.lit(True)).alias("proves"), F.when(F.col("score").isNull(), 5.0).otherwise(score).alias("score"), mode.alias("mode"))
