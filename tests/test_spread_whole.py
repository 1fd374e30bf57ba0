from turnloom.operators import recall
from turnloom.plans import search


def picked(spark, rows, query):
    t = spark.createDataFrame(rows, "user_id long, arrival long, position long, content string")
    q = spark.createDataFrame([(1, 1, query)], "query_id long, user_id long, query string")
    return sorted(r.arrival for r in recall.spread(recall.transcript_hits(t, q), "query_id", 8).collect())


def test_spread_covers_a_long_history(spark):
    """Thirty short turns with two hits at the start; longer stretches with one hit after them."""
    rows = [(1, k, k, "boats sail") for k in range(30)] + [(1, k, k, "some boats were seen, among much else") for k in range(30, 240)]
    rows += [(1, 500, 500, "nothing"), (2, 7, 7, "boats sail")]
    assert picked(spark, rows, "boats sail") == [0, 30, 60, 90, 120, 150, 180, 210]


def test_best_turn_of_a_position(spark):
    rows = [(1, 10, 3, "boats"), (1, 11, 3, "boats sail"), (1, 12, 3, "boats sail"), (1, 13, None, "boats sail"), (1, 14, 4, "boat")]
    assert picked(spark, rows, "boats sail") == [11]
    assert picked(spark, rows, "the") == [10, 14]  # a query without tokens takes all


def test_registered_search_covers_more(spark, sf):
    rows = search.transcript_search(spark, sf).collect()
    assert rows and max(r.ord for r in rows) <= 8
