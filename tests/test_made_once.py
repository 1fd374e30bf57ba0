"""Word steps on columns: the same results as the definitions, and nothing that is dear is planned twice."""

import random

from pyspark.sql import functions as F

from turnloom.functions import dates, text
from turnloom.operators import ranking, temporal

PARTS = ["Walked", "sing", "singing", "abced", "ab'sed", "'s", "''", "it's", "x'", "Bed", "ing", "seed", "runninging", "a", "don't", "2023", "École", "ed", "walking's", "-"]


def texts(spark):
    rng = random.Random(3)
    rows = [(n, rng.choice(["", " ", "\n"]).join(rng.choice(PARTS) for _ in range(rng.randint(0, 9)))) for n in range(300)]
    return spark.createDataFrame([*rows, (300, None)], "id long, t string")


def test_stemmed_words_are_stems_of_words(spark):
    words = F.regexp_extract_all(F.lower("t"), F.lit("[a-z0-9']+"), F.lit(0))
    rows = texts(spark).select(text.stemmed_words(F.col("t")).alias("got"), F.transform(words, text.stem).alias("want")).collect()
    assert all(r.got == r.want for r in rows) and sum(len(r.got or []) for r in rows) > 500


def test_relative_texts_have_a_trace(spark):
    said = ["We met two days ago", "been there for about 3 weeks", "LAST friday", "the previous month", "last  weekend", "Tonight", "mid-March", "on May 5", "in june\n", "may be", "Nothing", "agony", "Blast week"]
    rows = spark.createDataFrame([(x,) for x in said], "t string")
    rows = rows.select("t", dates.parse_relative(F.col("t"), F.lit(1704067200.0)).isNotNull().alias("found"), F.col("t").rlike(dates.RELATIVE).alias("trace")).collect()
    assert all(r.trace for r in rows if r.found) and sum(r.found for r in rows) >= 9
    assert {r.t for r in rows if not r.trace} >= {"Nothing", "agony", "Blast week"}


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_dear_columns_stand_once_in_a_plan(spark):
    """A filter on what was made doesn't make it again."""
    q = spark.createDataFrame([(1, "How long between planted roses and adopted a puppy?")], "query_id long, query string")
    sides = temporal.question_sides(q)
    one = optimized(q.select(text.sides(F.col("query")))).count("between")
    assert optimized(sides).count("between") <= one + 2  # and the two loose sides
    e = spark.createDataFrame([(1, 5, "We planted roses 3 days ago. It rained.", 1704067200)], "query_id long, node_id long, content string, said_at long")
    events = temporal.dated_events(e)
    assert optimized(events).count("pmod") <= optimized(q.select(dates.parse_relative(F.col("query"), F.lit(0.0) + F.rand()))).count("pmod")
    assert {(r.event, r.kind) for r in events.collect()} == {("We planted roses 3 days ago.", "event"), ("We planted roses 3 days ago. It rained.", "session")}


def test_terms_are_looked_up_as_rows(spark):
    """Repeated terms count, those that nobody asks for don't, and no lambda runs over a text's terms."""
    docs = spark.createDataFrame([(1, 1, ["a", "b", "a"]), (1, 2, ["c"]), (2, 3, ["a"])], "u long, d long, terms array<string>")
    asked = spark.createDataFrame([(7, 1, ["a", "x"]), (8, 2, ["b"])], "q long, u long, terms array<string>")
    made = ranking.bm25(docs, asked, "u", "d", "q")
    assert [(r.q, r.d) for r in made.collect()] == [(7, 1)]
    assert "lambdafunction" not in optimized(made)
