import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from turnloom.functions import text as fn
from turnloom.operators import ranking, retrieval
from turnloom.plans import lattice
from turnloom.plans import views as v
from turnloom.sources import postings, snapshots

FIELDS = {"stems": postings.Field(fn.stemmed_words), **retrieval.FIELDS}


def three_batches(spark, path, nodes, **more):
    """An index of ``nodes`` after inserts, deletes, a replacement and a batch that comes twice."""
    index = postings.PostingIndex(spark, path, FIELDS, **more)
    part = lambda k: nodes.where(F.pmod(F.col("id"), F.lit(3)) == k)
    wrong = part(1).withColumn("content", F.concat(F.lit("zzz rubbish "), "content"))
    assert index.apply("a", part(0).unionByName(wrong))
    assert index.apply("b", part(2).unionByName(part(1).where("id % 2 = 0")), part(0).select("user_id", "id"))
    assert not index.apply("b", part(1), part(2).select("user_id", "id"))
    assert index.apply("c", part(0).unionByName(part(1).where("id % 2 = 1")), part(1).where("id % 2 = 1").select("user_id", "id"))
    return index


@pytest.mark.parametrize("fanout", [99, 2])
def test_index_equals_the_texts_that_stand(spark, sf, tmp_path, fanout):
    nodes = v.nodes(spark, sf).select("user_id", "id", "content").cache()
    index = three_batches(spark, f"file://{tmp_path}/i", nodes, buckets=5, fanout=fanout)
    assert (len(index.state["segments"]) == 3) == (fanout == 99)
    assert sorted(map(tuple, index.rows().collect())) == sorted(map(tuple, nodes.select("user_id", "id").collect()))
    asked = v.queries(spark, sf).select("query_id", "user_id", fn.stemmed_words(F.col("query")).alias("terms"))
    docs = nodes.select("user_id", "id", fn.stemmed_words(F.col("content")).alias("terms"))
    want = {(r.query_id, r.id): r.score for r in ranking.bm25(docs, asked, "user_id", "id", "query_id").collect()}
    index = postings.PostingIndex(spark, f"file://{tmp_path}/i", FIELDS)  # opened again
    got = {(r.query_id, r.id): r.score for r in index.scores("stems", asked, "query_id").collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want) and want
    few = asked.where("query_id % 700 = 0")
    assert {(r.query_id, r.id) for r in index.scores("stems", few, "query_id").collect()} == {k for k in want if k[0] % 700 == 0}
    index.merge()
    assert {(r.query_id, r.id) for r in index.scores("stems", asked, "query_id").collect()} == want.keys()
    held = index._read("terms").where("df <= 0").count(), index._read("gone").count()
    assert held == (0, 0)


def test_retrieval_on_a_maintained_index(spark, sf, tmp_path):
    memory, q = lattice.memory(spark, sf), lattice._questions(spark, sf)
    index = three_batches(spark, f"file://{tmp_path}/i", memory.nodes, fanout=3)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(retrieval.retrieve(q, memory, index=index)) == rows(retrieval.retrieve(q, memory)) != []


def test_changes_of_a_small_index(spark, tmp_path):
    index = postings.PostingIndex(spark, f"file://{tmp_path}/i", {"w": postings.Field(lambda c: F.split(c, " "))})
    rows = lambda *x: spark.createDataFrame(list(x), "user_id long, id long, content string")
    asked = spark.createDataFrame([(1, 1, ["a", "b"]), (2, 2, ["a"]), (3, 3, ["a"])], "query_id long, user_id long, terms array<string>")
    assert index.scores("w", asked, "query_id").count() == 0
    index.apply("1", rows((1, 1, "a b"), (1, 2, "a a"), (1, 2, "a c"), (1, 3, None), (2, 1, "a")), rows((1, 9, "")))
    found = lambda: {(r.query_id, r.id) for r in index.scores("w", asked, "query_id").collect()}
    every = lambda: {(r.query_id, r.id) for r in index.with_all("w", asked, "query_id").collect()}
    assert found() == {(1, 1), (1, 2), (2, 1)} and every() == {(1, 1), (2, 1)}
    sums = {r.scope: (r.n, r.length) for r in index._read("sums").collect()}
    assert sums == {1: (3, 4), 2: (1, 1)}  # of two texts of one id the greater counts
    index.apply("2", rows((2, 1, "b")), rows((1, 2, ""), (1, 2, ""), (7, 7, "")))
    assert found() == {(1, 1)} and every() == {(1, 1)}
    index.apply("3", rows((1, 2, "b a")))
    assert found() == {(1, 1), (1, 2)} == every()
    index.apply("4", rows().limit(0), rows((1, 1, ""), (1, 2, ""), (1, 3, ""), (2, 1, "")))
    assert found() == set() and index.rows().count() == 0
    index.merge()
    assert found() == set() and len(index.state["segments"]) == 1


def test_a_question_reads_its_own_buckets(spark, sf, tmp_path):
    index = postings.PostingIndex(spark, f"file://{tmp_path}/i", {"w": postings.Field(fn.stemmed_words)}, buckets=8)
    index.apply("1", v.nodes(spark, sf).select("user_id", "id", "content"))
    asked = v.queries(spark, sf).limit(1)
    buckets, _ = index._asked(asked)
    files = index._read("postings", None, "w", buckets).inputFiles()
    assert len(buckets) == 1 and files and {f.split("bucket=")[1].split("/")[0] for f in files} == {str(next(iter(buckets)))}


def test_a_dead_writer_does_not_lock_the_tables(spark, tmp_path):
    tables = snapshots.VersionedTables(spark, f"file://{tmp_path}/v")
    first = tables.publish({"t": spark.range(1)})
    (tmp_path / "v/current-00000001").touch()  # created, never written
    assert tables.version() == first
    second = tables.publish({"t": spark.range(2)}, expected=first)
    assert tables.read("t").count() == 2
    (tmp_path / "v/current-00000003").touch()
    tables.restore(first)
    assert tables.version() == first and tables.read("t").count() == 1 and second != first
    tables.clear({"t": spark.range(1)})
    assert tables.read("t").count() == 0


def test_an_overtaken_writer_is_told(spark, tmp_path):
    slow = snapshots.Pointers(spark, f"file://{tmp_path}/v")
    slow.point("one")
    real = slow.taken

    def taken():  # another writer takes the number after the one this writer is about to write
        seen = real()
        if len(seen) == 2:
            (tmp_path / "v/current-00000009").write_text("three")
            return real()
        return seen

    slow.taken = taken
    with pytest.raises(RuntimeError):
        slow.point("two")
    assert snapshots.Pointers(spark, f"file://{tmp_path}/v").newest() == "three"


def test_counts_are_signed_sums(spark, sf, tmp_path):
    nodes = v.nodes(spark, sf).select("user_id", "id", "content")
    index = three_batches(spark, f"file://{tmp_path}/i", nodes)
    want, got = defaultdict(int), Counter()
    for r in nodes.select("user_id", F.array_distinct(fn.stemmed_words(F.col("content"))).alias("t")).collect():
        for t in r.t:
            want[r.user_id, t] += 1
    for r in index._read("terms", None, "stems").collect():
        got[r.scope, r.term] += r.df
    assert {k: n for k, n in got.items() if n} == want
