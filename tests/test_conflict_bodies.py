from turnloom.plans import memory
from turnloom.plans import views as v


def test_conflicts_by_topic_or_body(spark):
    nodes = spark.createDataFrame([(1, "user: Tea is fine"), (2, "user: no, COFFEE is"), (3, "user: ox"), (4, "user: elk")], "id long, content string")
    known = spark.createDataFrame([(1, 10, 1, 2, "tea"), (1, 11, 3, 4, "animals"), (2, 12, 1, 2, "tea"), (1, 13, 1, 99, "coffee")], "user_id long, id long, a_id long, b_id long, topic string")
    asked = ["tea", "my coffee", " ox ", "animals", "el", "zebra", "is fin", "of it"]
    q = spark.createDataFrame([(k, 1, t) for k, t in enumerate(asked)], "query_id long, user_id long, query string")
    rows = memory.matching_conflicts(q, known, nodes).collect()
    assert {(asked[r.query_id], r.id) for r in rows} == {("tea", 10), ("my coffee", 10), (" ox ", 11), ("animals", 11), ("el", 11), ("is fin", 10)}
    assert {(r.a_content, r.b_content) for r in rows if r.id == 11} == {("user: ox", "user: elk")}


def test_registered_conflicts_equal_brute_force(spark, sf):
    text = {r.id: r.content.lower() for r in v.nodes(spark, sf).collect()}
    tokens = {r.query_id: r.t for r in v.queries(spark, sf).select("query_id", memory.fn.query_tokens("query").alias("t")).collect()}
    want, known = set(), v.conflicts(spark, sf).collect()
    for q in v.queries(spark, sf).collect():
        low = q.query.strip().lower()
        for c in known:
            both = f"{text[c.a_id]} {text[c.b_id]}"
            if c.user_id == q.user_id and (low in c.topic or low in both or any(t in c.topic for t in tokens[q.query_id]) or any(len(w) > 3 and w in both for w in low.split())):
                want.add((q.query_id, c.id))
    rows = memory.search_conflicts(spark, sf).collect()
    assert len(rows) == len(want) and {(r.query_id, r.id) for r in rows} == want
