import random
from collections import defaultdict

from pyspark.sql import functions as F

from tests import plain_retrieval as plain
from turnloom.operators import ranking, retrieval, temporal
from turnloom.plans import lattice
from turnloom.plans import views as v


def by_user(df):
    made = defaultdict(list)
    for r in df.collect():
        made[r.user_id].append(r.asDict())
    return made


def stores(spark, sf):
    m = lattice.memory(spark, sf)
    parts = [by_user(x) for x in m]
    return m, {u: plain.Store(*(p[u] for p in parts)) for u in parts[0]}


def test_routed_retrieval_equals_plain_python(spark, sf):
    """Every question of the smallest tables, all abilities among them."""
    memory, made = stores(spark, sf)
    said = memory.timeline.where("t_kind = 'absolute'").select(F.col("node_id").alias("id"), F.col("t_sort").alias("said_at"))
    rows = memory.nodes.join(said, "id").select(F.lit(0).alias("query_id"), F.col("id").alias("node_id"), "content", "said_at")
    dated = defaultdict(list)
    for r in temporal.dated_events(rows).collect():
        dated[r.node_id].append((r.event, r.epoch, r.kind))
    questions = lattice._questions(spark, sf).collect()
    want = {}
    for q in questions:
        ability, widened, why, ids = plain.retrieve(made[q.user_id], q.query, dated)
        want |= {(q.query_id, n): (ability, widened, why, i) for n, i in enumerate(ids, 1)}
    got = {(r.query_id, r["rank"]): (r.ability, r.widened, r.reason, r.node_id) for r in lattice.retrieve_routed(spark, sf).collect()}
    assert {a for a, *_ in got.values()} >= {"contradiction", "event_ordering", "temporal", "preference", "extraction", "default"}
    assert got == want


def test_shortlist_and_timeline_equal_plain_python(spark, sf):
    memory, made = stores(spark, sf)
    questions = lattice._questions(spark, sf).collect()
    got = {(r.query_id, r["rank"]): r.node_id for r in lattice.fusion_candidates(spark, sf).collect()}
    assert got == {(q.query_id, n): i for q in questions for n, i in enumerate(made[q.user_id].fused(q.query, 48), 1)}
    got = {(r.query_id, r["rank"]): r.node_id for r in lattice.timeline_sides(spark, sf).collect()}
    assert got == {(q.query_id, n): i for q in questions for n, i in enumerate(made[q.user_id].timeline_sides(q.query, 12), 1)}
    assert v.nodes(spark, sf).count() == sum(len(s.node) for s in made.values())


def test_cosine_in_blocks_equals_one_pass(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    q = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    one, many = ranking.cosine_topk(e, q, 3), ranking.cosine_topk(e, q, 3, block=4)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) != []


def test_cosine_of_odd_vectors_and_copies_without_a_row_for_each_pair(spark):
    """The rows of the plain join, which made one for each pair; copies tie by their ids."""
    nan, rng = float("nan"), random.Random(5)
    odd = [None, [], [0.0, 0.0], [1.0, None], [nan, 1.0], [float("inf"), 1.0], [1.0, 2.0, 3.0], [1e200, 1e200], [-0.0, 1.0], [1e-160, 1e-161], [1e-170, 3e-170], [1e-300, 0.0]]
    rows = odd + [[0.25, 0.5]] * 90 + [[rng.choice([0.1, 0.2, 0.3]), rng.random()] for _ in range(150)]
    e = spark.createDataFrame([*enumerate(rows), (None, [1.0, 2.0])], "vec_id long, embedding array<double>").repartition(3)
    q = e.where("vec_id < 30 OR vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    got = ranking.cosine_topk(e, q, 4, block=20)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    pairs = e.join(F.broadcast(q), F.col("query_id") != F.col("vec_id")).withColumn("score", F.round(ranking.cosine(F.col("q"), F.col("embedding")), 6))
    want = ranking.top(pairs, "query_id", 4, F.desc("score"), "vec_id").select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 200


def test_contracts_by_hand(spark):
    claim, order = "You said two things", "List the order of three things I mentioned"
    named = "How many days between planting roses and adopting the puppy?"
    old, new = (5, 1, "I own a boat", 10.0, False, None, 0, "user"), (6, 2, "I own no boat", 20.0, True, None, 1, "user")
    turn = lambda n, text, role="user": (n, n, text, None, True, None, n, role)
    when = lambda n, text, at: (n, n, text, at, True, None, n, "user")
    cases = [
        (claim, [old, new], None),  # superseded and current, both dated
        (claim, [old, (*new[:3], None, *new[4:])], "cr_claims_undated"),
        (claim, [new], "cr_missing_second_claim"),
        (claim, [(*new[:5], 7, *new[6:]), (7, 3, "no", None, True, None, 2, "user")], "cr_claims_undated"),
        (order, [turn(1, "a b"), turn(2, "c"), turn(3, "d", "assistant")], "eo_not_enough_ordered_events"),
        (order, [turn(1, "a b"), turn(2, "c"), turn(3, "d")], None),
        (named, [when(1, "planted roses", 10.0), when(2, "more", 20.0)], "eo_named_events_not_both_dated"),
        (named, [when(1, "planted roses", 10.0), when(2, "adopted a puppy", 20.0)], None),
        ("When was it?", [when(1, "x", 10.0)], "eo_fewer_than_two_dated_events"),
        ("When was it?", [], "empty_pack"),
    ]
    schema = "query_id long, node_id long, rank long, content string, said_at double, current boolean, rival long, source_position long, source_role string"
    e = spark.createDataFrame([(n, *r) for n, (_, rows, _) in enumerate(cases) for r in rows], schema)
    q = spark.createDataFrame([(n, query) for n, (query, *_) in enumerate(cases)], "query_id long, query string")
    assert {r.query_id: r.reason for r in temporal.contracts(q, e).collect()} == {n: why for n, (*_, why) in enumerate(cases)}


def test_gate_and_complete_runs(spark):
    from turnloom.operators import evals

    assert [evals.gate(x, 938, 880, 1382) for x in (924, 925, 951, 952, 879)] == [False, True, True, False, False]
    expected = spark.createDataFrame([("a",), ("b",)], "qa_id string")
    rows = lambda *x: spark.createDataFrame(list(x), "qa_id string, score double, success boolean")
    a, b = ("a", 1.0, True), ("b", 0.0, True)
    assert evals.correct_count(rows(a, b), expected) == 1
    for bad in ([a], [a, b, a], [("a", 1.0, False), b], [("a", None, True), b], [("a", 1.0, None), b]):
        try:
            evals.correct_count(rows(*bad), expected)
            raise AssertionError(bad)
        except ValueError:
            pass


def test_second_writer_cannot_publish(spark, tmp_path):
    from turnloom.sources import snapshots

    one, two = (snapshots.VersionedTables(spark, f"file://{tmp_path}/v") for _ in range(2))
    first = one.publish({"t": spark.range(1)})
    two.pointers.taken = lambda seen=two.pointers.taken(): seen  # looks before the first writer's file is there
    one.publish({"t": spark.range(2)}, expected=first)
    try:
        two.publish({"t": spark.range(3)})
        raise AssertionError("published over another version")
    except RuntimeError:
        assert one.read("t").count() == 2
