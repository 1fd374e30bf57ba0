import math

import pytest
from pyspark.sql import functions as F

from turnloom.functions.text import stemmed_words
from turnloom.operators import evals, ranking, recall, store, temporal
from turnloom.sources import files, snapshots, transcripts
from turnloom.streaming import ingest


def turns(spark, rows):
    return spark.createDataFrame(rows, "user_id long, session_id long, position long, arrival long, said_at long, turn_text string")


HISTORY = [
    (1, 1, 0, 10, 200, "user: the red boat"),
    (1, 1, 1, 11, 200, "assistant: a boat, a boat"),
    (1, 2, 0, 20, 100, "user: green apples"),
    (1, 3, 0, 30, None, "user: nothing here"),
    (2, 4, 0, 40, 50, "user: boat of another"),
]


def test_ranked_turns_by_hand(spark):
    placed = recall.placed(turns(spark, HISTORY)).withColumn("text", F.col("turn_text"))
    q = spark.createDataFrame([(7, 1, "boat boat"), (8, 1, "zzz"), (9, 3, "boat")], "query_id long, user_id long, query string")
    rows = ranking.ranked_turns(placed, q, stemmed_words, 3).collect()
    got = {(r.query_id, r.rank): (r.arrival, r.score) for r in rows}
    mean, idf = (4 + 5 + 3 + 3) / 4, math.log(1 + (4 - 2 + 0.5) / (2 + 0.5))
    score = lambda tf, dl: round(2 * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean)), 9)
    assert got[(7, 1)] == (11, score(2, 5)) and got[(7, 2)] == (10, score(1, 4))
    assert got[(7, 3)] == (20, 0.0)  # no shared term: the history's order, session 2 being dated first
    assert [got[(8, k)][0] for k in (1, 2, 3)] == [20, 10, 11]
    assert not [k for k in got if k[0] == 9]  # a user without turns


def test_session_order_and_merging(spark):
    order = recall.session_order(turns(spark, HISTORY)).where("user_id = 1").orderBy("session_rank")
    assert [r.session_id for r in order.collect()] == [2, 1, 3]
    merged = recall.merged(recall.sessions(turns(spark, HISTORY)), 2).where("user_id = 1").orderBy("item").collect()
    assert merged[0].content == "(conversation on 1970-01-01)\nuser: green apples\n(conversation on 1970-01-01)\nuser: the red boat\nassistant: a boat, a boat"
    assert merged[1].content == "user: nothing here"
    for budget, fits in ((1000, True), (5, False)):
        assert {r.fits for r in recall.full_recall(turns(spark, HISTORY), 20, budget).where("user_id = 1").collect()} == {fits}


def test_blocks_and_knapsack_are_greedy(spark):
    t = turns(spark, [(1, 1, k, k, None, "x" * n) for k, n in enumerate((50, 40, 200, 10, 80))])
    assert [r.block for r in recall.blocks(t, 100).orderBy("position").collect()] == [0, 0, 1, 2, 2]
    units = spark.createDataFrame([(1, k, c) for k, c in enumerate((5, 9, 4, 1))], "q long, ord long, cost long")
    assert [r.chosen for r in recall.knapsack(units, "q", 10).orderBy("ord").collect()] == [True, False, True, True]


def test_spans_merge_in_one_pass(spark):
    hits = lambda ps: spark.createDataFrame([(1, i, 100 + p, 5, p) for i, p in enumerate(ps)], "query_id long, rank long, arrival long, session_id long, position long")
    spans = lambda ps: [(r.low, r.high) for r in recall.hit_spans(hits(ps), 1).orderBy("span").collect()]
    assert spans([0, 3, 9]) == [(-1, 4), (8, 10)]
    assert spans([0, 6, 3]) == [(-1, 4), (5, 7)]  # the last joins the first, which then touches the second


def test_spread_covers_positions(spark):
    rows = spark.createDataFrame([(1, p, r) for r, p in enumerate([90, 91, 92, 5, 50, None])], "q long, position long, rank long")
    assert sorted(r.position for r in recall.spread(rows, "q", 3).collect()) == [5, 50, 90]


def test_items_drop_repeats_and_fragments(spark):
    rows = spark.createDataFrame([(1, 1, "ab"), (1, 2, "xaby"), (1, 3, "xaby"), (2, 1, "ab")], "query_id long, rank long, content string")
    assert {(r.query_id, r.rank) for r in recall.distinct_items(rows).collect()} == {(1, 2), (2, 1)}


def test_supersession_by_event_time(spark):
    rows = [(1, 2, 10.0, 500.0, 20.0, 900.0), (1, 2, 10.0, 900.0, 20.0, 500.0), (1, 2, 10.0, 10.0, 20.0, 900.0)]
    got = store.superseded(spark.createDataFrame(rows, "a long, b long, a_ts double, a_from double, b_ts double, b_from double")).collect()
    assert [tuple(r) for r in got] == [(1, 2, 900.0), (2, 1, 900.0), (2, 1, 10.0)]


def test_unknown_edge_kind_raises(spark):
    with pytest.raises(Exception, match="unknown edge kind"):
        spark.range(1).select(store.checked_kind(F.lit("friend"))).collect()


def test_coverage_and_accuracy(spark):
    p = spark.createDataFrame([("a",), ("a",), ("x",)], "qa_id string")
    e = spark.createDataFrame([("a",), ("b",)], "qa_id string")
    assert {tuple(r) for r in evals.coverage(p, e).collect()} == {("x", "unknown"), ("a", "duplicate"), ("b", "missing")}
    o = spark.createDataFrame([(f"q{i}", str(i % 9), str(i % 3), int(i % 2), int(i % 4 == 0)) for i in range(400)], "qa_id string, cluster string, category string, a int, b int")
    assert evals.accuracy(o).first().accuracy == 0.5
    r = evals.cluster_bootstrap(o, 300).first()
    assert r.low <= r.diff <= r.high and r.diff == 0.25


def test_temporal_order_refuses_mixed_kinds(spark):
    e = spark.createDataFrame([(1, 0, 0.0, "event"), (1, 1, 864000.0, "event"), (2, 0, 0.0, "event"), (2, 1, 5.0, "session")], "query_id long, side long, epoch double, kind string")
    got = {r.query_id: (r.comparable, r.first_side, r.gap) for r in temporal.compared(e).collect()}
    assert got[1] == (True, 0, "10 days; 1 week 3 days; 0 months 10 days") and got[2] == (False, None, None)


def test_gap_fact(spark):
    q = spark.createDataFrame([(1, "How many days between the garden show and the boat trip?"), (2, "Where is it?")], "query_id long, query string")
    c = [(1, "the garden show was on May 3", 100 * 86400.0), (1, "our boat trip began", 120 * 86400.0), (1, "something else entirely", None)]
    m = spark.createDataFrame([x for x in c if x[2] is not None], "query_id long, clause string, epoch double")
    r = temporal.gap_facts(q, m, spark.createDataFrame([x[:2] for x in c], "query_id long, clause string")).collect()
    assert len(r) == 1 and r[0].gap == "20 days (about 2 weeks)"


def test_char_chunks(spark):
    t = "aaaa bbbb cccc " + "d" * 25
    df = spark.createDataFrame([(1, t), (2, ""), (3, None)], "k long, t string")
    pieces = [r.piece for r in temporal.char_chunks(df, "k", "t", 10).orderBy("chunk").collect()]
    assert pieces[0] == "aaaa bbbb" and max(map(len, pieces)) <= 10
    assert "".join(pieces).replace(" ", "") == t.replace(" ", "")


def test_transcripts(spark):
    msg = [("Ann", "Hi", ["u"], "a cat", "cats"), ("Bob", "Yo", None, None, None)]
    df = spark.createDataFrame([("s", "Ann", "Bob", [(1, "1:56 pm on 8 May, 2023", msg)])], transcripts.SCHEMA)
    rows = transcripts.messages(df).orderBy("position").collect()
    assert rows[0].timestamp_ms == 1683554160000 and [r.role for r in rows] == ["user", "assistant"]
    assert rows[0].content == "Ann: Hi\n[images] u\n[caption] a cat\n[query] cats"
    with pytest.raises(Exception, match="unknown speaker"):
        transcripts.messages(spark.createDataFrame([("s", "Ann", "Bob", [(1, "1:56 pm on 8 May, 2023", [("Eve", "x", None, None, None)])])], transcripts.SCHEMA)).collect()


def test_files_fail_closed(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": 2')
    with pytest.raises(Exception):
        files.read_json_lines(spark, str(tmp_path / "a.jsonl"), "a long").collect()
    rows = spark.createDataFrame([(1, "x")], "a long, b string")
    assert files.write_frozen(rows, f"{tmp_path}/f") and not files.write_frozen(rows, f"{tmp_path}/f")
    with pytest.raises(ValueError, match="frozen"):
        files.write_frozen(spark.createDataFrame([(2, "x")], "a long, b string"), f"{tmp_path}/f")
    (tmp_path / "m").mkdir()
    (tmp_path / "m/x").write_text("1")
    (tmp_path / "m/z").write_text("2")
    m = spark.createDataFrame([("x", "0"), ("y", "0")], "name string, sha256 string")
    assert {tuple(r) for r in files.verify_manifest(spark, f"{tmp_path}/m", m).collect()} == {("x", "changed"), ("y", "missing"), ("z", "extra")}


def test_versions(spark, tmp_path):
    tables = snapshots.VersionedTables(spark, f"file://{tmp_path}/v")
    assert tables.version() is None
    first = tables.publish({"t": spark.range(3)})
    second = tables.publish({"t": spark.range(5)}, expected=first)
    assert tables.read("t").count() == 5 and tables.read("t", first).count() == 3
    with pytest.raises(RuntimeError):
        tables.publish({"t": spark.range(1)}, expected=first)
    tables.restore(first)
    assert tables.read("t").count() == 3 and second != first
    tables.clear({"t": spark.range(1)})
    assert tables.read("t").count() == 0


def test_ingest_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "i")
    rows = lambda *x: spark.createDataFrame(list(x), ingest.REQUEST)
    a = ("u", "r1", "s", 0, "user", "hello", 1000)
    b = ("u", "r1", "s", 1, "assistant", "hi", None)
    outcome = lambda df: {r.request_id: r.outcome for r in df.collect()}
    assert outcome(ingest.add(spark, path, rows(a, b), 0)) == {"r1": "new"}
    assert outcome(ingest.add(spark, path, rows(a, b), 0)) == {"r1": "new"}  # the batch again
    assert outcome(ingest.add(spark, path, rows(a, b, ("u", "r2", "s", 0, "user", "more", None)), 1)) == {"r1": "duplicate", "r2": "new"}
    assert outcome(ingest.add(spark, path, rows(("u", "r1", "s", 0, "user", "other", 1000)), 2)) == {"r1": "conflict"}
    got = spark.read.parquet(f"{path}/turns").orderBy("position").collect()
    assert [(r.position, r.content) for r in got] == [(0, "hello"), (1, "hi"), (2, "more")]


def test_ingest_stream(spark, tmp_path):
    rows = spark.createDataFrame([("u", f"r{i}", "s", 0, "user", f"m{i}", i) for i in range(5)], ingest.REQUEST)
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        source = spark.readStream.schema(ingest.REQUEST).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        ingest.stream(source, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/turns")
    assert sorted(r.position for r in got.collect()) == [0, 1, 2, 3, 4]
