"""Evaluation runs: coverage, accuracy, paired outcomes, whole-cluster bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage(predictions: DataFrame, expected: DataFrame) -> DataFrame:
    """qa_id, problem of unknown, duplicate and missing predictions; none if the run is complete."""
    counts = predictions.groupBy("qa_id").agg(F.count(F.lit(1)).alias("n"))
    problem = lambda df, name: df.select("qa_id", F.lit(name).alias("problem"))
    return (
        problem(counts.join(expected, "qa_id", "left_anti"), "unknown")
        .unionByName(problem(counts.where("n > 1"), "duplicate"))
        .unionByName(problem(expected.select("qa_id").distinct().join(counts, "qa_id", "left_anti"), "missing"))
    )


def correct_count(rows: DataFrame, expected: DataFrame) -> int:
    """How many of the scored ``rows`` (qa_id, score, success) are right; a run that is not complete,
    not unique or not successful, or that lacks a score, raises."""
    if not coverage(rows, expected).isEmpty():
        raise ValueError("the run doesn't have each question once")
    bad = F.count_if(~F.coalesce("success", F.lit(False)) | F.col("score").isNull())
    got = rows.agg(bad.alias("bad"), F.count_if(F.col("score") >= 0.5).alias("correct")).first()
    if got["bad"]:
        raise ValueError(f"{got['bad']} rows failed or have no score")
    return got["correct"]


def gate(correct, original, least, n):
    """Whether a rerun's ``correct`` of ``n`` is at least ``least`` and within one point of ``original``,
    unrounded. Columns or numbers."""
    return (correct >= least) & (100 * abs(correct - original) <= n) if isinstance(correct, int) else (correct >= least) & (F.abs(correct - original) * 100 <= n)


def pending(expected: DataFrame, done: DataFrame) -> DataFrame:
    """qa_id of what is ``expected`` and not yet ``done``."""
    return expected.select("qa_id").distinct().join(done, "qa_id", "left_anti")


def resumed(done: DataFrame, made: DataFrame) -> DataFrame:
    """``done`` and those rows of ``made`` that it has no answer to: a completed answer stays."""
    return done.unionByName(made.join(done, "qa_id", "left_anti"))


def accuracy(outcomes: DataFrame, *keys: str) -> DataFrame:
    """keys, n, correct, accuracy of the 0/1 column ``a``."""
    agg = (F.count("a").alias("n"), F.sum("a").alias("correct"), F.round(F.avg("a"), 6).alias("accuracy"))
    return outcomes.groupBy(*keys).agg(*agg) if keys else outcomes.agg(*agg)


def paired(outcomes: DataFrame) -> DataFrame:
    """both, only_a, only_b, neither of the 0/1 columns a and b."""
    hit = lambda a, b: F.count_if((F.col("a") == a) & (F.col("b") == b))
    return outcomes.agg(hit(1, 1).alias("both"), hit(1, 0).alias("only_a"), hit(0, 1).alias("only_b"), hit(0, 0).alias("neither"))


def cluster_bootstrap(outcomes: DataFrame, draws: int = 100_000, seed: int = 20261002, low: float = 0.00625, high: float = 0.99375) -> DataFrame:
    """diff, low, high: the difference of a and b, and its interval over draws of whole clusters.

    Clusters are reduced to sums first; a draw takes as many clusters as there are, with
    repetition, by a seeded hash of (draw, pick). Questions weigh equally.
    """
    spark = outcomes.sparkSession
    sums = outcomes.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a") - F.col("b")).alias("d"))
    listed = sums.agg(F.array_sort(F.collect_list(F.struct("cluster", "n", "d"))).alias("c"))  # a row for each cluster
    picks = spark.range(draws).crossJoin(F.broadcast(listed)).select(
        "id",
        F.transform(
            F.sequence(F.lit(1), F.size("c")),
            lambda i: F.element_at("c", (F.pmod(F.xxhash64(F.lit(seed), "id", i), F.size("c").cast("long")) + 1).cast("int")),
        ).alias("p"),
    )
    total = lambda name: F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x[name])
    drawn = picks.select((total("d") / total("n")).alias("diff"))
    band = drawn.agg(F.percentile("diff", F.lit(low)).alias("low"), F.percentile("diff", F.lit(high)).alias("high"))
    return outcomes.agg(F.avg(F.col("a") - F.col("b")).alias("diff")).crossJoin(band)
