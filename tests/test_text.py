import pytest
from pyspark.sql import functions as F

from turnloom.functions import dates, text

MAY_8 = 1683554160.0  # 8 May 2023, 13:56 UTC, a Monday


def one(spark, column, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(column.alias("x")).first().x


def test_tokens_and_stems(spark):
    got = lambda f, t: one(spark, f(F.col("t")), t=t)
    assert got(text.query_tokens, "When did I fix the cat's 'door' and the door-bell?") == ["fix", "cat's", "door", "door-bell"]
    assert got(text.stemmed_words, "Fixing planted Cat's '") == ["fix", "plant", "cat", ""]
    assert got(text.lexical_tokens, "Über glasses class, 2 dogs") == ["über", "glasse", "class", "dogs"]
    assert got(text.fts_terms, "The well-known 'Foo' and foo a_b") == ["well-known", "foo", "a_b"]
    assert got(text.estimate_tokens, "abc 12!") == 5
    assert got(text.sentences, "One. Two!\n\nThree? ") == ["One.", "Two!", "Three?"]
    assert got(text.clauses, "On January 15, 2023 we met, and talked; then left") == ["On January 15 2023 we met", "and talked", "then left"]


def test_sides_and_routes(spark):
    sides = lambda t: one(spark, text.sides(F.col("t")), t=t)
    assert sides("How long between the garden show and the boat trip?") == [["garden", "show"], ["boat", "trip"]]
    assert sides("Which came first, the red car or the blue bike?") == [["red", "car"], ["blue", "bike"]]
    assert sides("What is my dog called?") == [["dog", "called"]]
    route = lambda t: one(spark, text.ability(F.col("t")), t=t)
    assert [route(t) for t in ("Which is correct?", "What order?", "When was it?", "My favorite?", "Who is it?", "Hm")] == [
        "contradiction", "event_ordering", "temporal", "preference", "extraction", "default",
    ]
    assert one(spark, text.requested_length(F.col("t")), t="Mention three items") == 3


@pytest.mark.parametrize(
    ("phrase", "epoch"),
    [
        ("at 2023-05-08T13:56", MAY_8), ("on March 3, 2023.", 1677801600.0), ("12 Apr 2022", 1649721600.0), ("in June 2020", 1590969600.0),
        ("2023-02-30", None), ("2023-02-30 or March 3, 2023", 1677801600.0), ("never", None),
    ],
)
def test_absolute_dates(spark, phrase, epoch):
    got = one(spark, dates.parse_absolute(F.col("t")), t=phrase)
    assert (got.epoch if got else None) == epoch


@pytest.mark.parametrize(
    ("phrase", "back"),
    [
        ("yesterday", 86400), ("3 days ago", 3 * 86400), ("a week ago", 7 * 86400), ("last monday", 7 * 86400), ("last Sunday", 86400),
        ("last weekend", 2 * 86400), ("tonight", 0), ("tomorrow", -86400), ("been busy for 2 weeks", 14 * 86400), ("a couple of days ago", 2 * 86400),
        ("last month", 30 * 86400), ("a year ago", 365 * 86400),
    ],
)
def test_relative_dates_keep_the_time_of_day(spark, phrase, back):
    assert one(spark, dates.parse_relative(F.col("t"), F.col("a")), t=phrase, a=MAY_8).epoch == MAY_8 - back


def test_dates_without_a_year(spark):
    got = lambda t: one(spark, dates.month_day(F.col("t"), F.col("a")), t=t, a=MAY_8)
    assert got("in mid-February").epoch == 1676419200.0
    assert got("December 24th").epoch == 1671840000.0
    assert got("March 45").epoch == 1680220800.0  # clamped to the 31st
    assert got("in may") is None and got("June 3, 2020") is None


def test_shift_clamps_to_the_month_end(spark):
    march_31 = 1680278400.0
    assert one(spark, dates.shift(F.col("a"), F.lit(1)), a=march_31) == 1677600000.0


def test_phrases(spark):
    got = lambda t, a=MAY_8: one(spark, dates.resolve_phrases(F.col("t"), F.col("a")), t=t, a=a)
    assert got("Yesterday, last week, yesterday and next month") == [
        "Yesterday = 7 May 2023", "last week = the week before 8 May 2023", "next month = June 2023",
    ]
    assert got("two weeks ago; 3 months ago; a year ago; last weekend; this year") == [
        "two weeks ago = around 24 April 2023", "3 months ago = around February 2023", "a year ago = around 2022",
        "last weekend = the weekend before 8 May 2023", "this year = 2023",
    ]
    days = one(spark, dates.day_phrases(F.col("t"), F.col("a")), t="last Friday and two weeks ago and tomorrow", a=MAY_8)
    assert [(d.phrase, d.epoch) for d in days] == [("last Friday", 1683244800.0), ("tomorrow", 1683590400.0)]


def test_times_of_labels(spark):
    got = lambda t: tuple(one(spark, dates.extract_time(F.col("t"), F.col("a")), t=t, a=MAY_8))
    assert got("date=2023-05-08 we met yesterday") == (1683504000.0, "2023-05-08", "absolute")
    assert got("date=soon, on 2023-05-08") == (None, "soon", "malformed")
    assert got("we met yesterday")[2] == "relative"
    assert got("turn=12: hello") == (12.0, "turn=12", "ordinal") and got("turn=2,25 x")[2] == "malformed"
    assert got("hello") == (None, None, "none")


def test_gaps(spark):
    gap = lambda f, a, b: one(spark, f(F.col("a"), F.col("b")), a=float(a), b=float(b))
    day = 86400
    assert gap(dates.describe_gap, 0, 40 * day) == "40 days; 5 weeks 5 days; 1 month 9 days"
    assert gap(dates.span, 0, 14 * day) == "14 days (2 weeks)"
    assert gap(dates.span, 0, 400 * day) == "400 days (about 57 weeks, 13 months, 1 year)"
    assert gap(dates.span, 0, day) == "1 day"


def test_preference_words(spark):
    rows = [("I PREFER tea", True), ("from now on, coffee", True), ("it was nice", False), ("", False), (None, None), ("I Like it", True), ("nevertheless", True)]
    got = spark.createDataFrame(rows, "t string, want boolean").select("want", text.is_preference(F.col("t")).alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_claims_are_compared_by_folded_case(spark):
    rows = spark.createDataFrame([("Straße  ΟΔΟΣ",), ("STRASSE οδος ",)], "t string").select(text.normal_claim(F.col("t")).alias("c")).collect()
    assert rows[0].c == rows[1].c == "strasse οδοσ"


def test_the_last_vector_of_a_node_counts(spark):
    from turnloom.operators import store

    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    vectors = spark.createDataFrame([(1, [1.0], 5), (1, [9.0], 4), (2, None, 1), (1, None, 9)], "id long, embedding array<float>, ord long")
    got = {r.id: r.embedding for r in store.with_embeddings(nodes, vectors).collect()}
    assert got == {1: [1.0], 2: None, 3: None}


def test_sentences_keep_digits_and_lose_spaces(spark):
    """A sentence that begins or ends with its own place in the text keeps that digit."""
    said = "0 is first 0. 1 is next 1\n 2 has spaces 2 \n3.5 ends 3"
    assert one(spark, text.sentences(F.col("t")), t=said) == ["0 is first 0.", "1 is next 1", "2 has spaces 2", "3.5 ends 3"]
