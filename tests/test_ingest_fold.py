from collections import Counter
from pathlib import Path

from turnloom.streaming import ingest


def batch(spark, n):
    """Five requests of several users; one of the batch before comes again, one comes with another text."""
    rows = [(f"u{(n + k) % 7}", f"r{n}-{k}", f"s{k % 2}", i, "user", f"text {n} {k} {i}", None) for k in range(5) for i in range(2)]
    if n:
        rows += [(f"u{(n - 1) % 7}", f"r{n - 1}-0", "s0", i, "user", f"text {n - 1} 0 {i}", None) for i in range(2)]
        rows += [(f"u{n % 7}", f"r{n - 1}-1", "s1", 0, "user", "another text", None)]
    return spark.createDataFrame(rows, ingest.REQUEST)


def parts(path, table):
    return [x for x in (Path(path) / table).iterdir() if x.name.startswith("part=")]


def test_parts_do_not_grow_with_the_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "FOLD", 3)
    path, twice = f"{tmp_path}/a", f"{tmp_path}/b"
    outcomes = {}
    for n in range(9):
        outcomes[n] = Counter(r.outcome for r in ingest.add(spark, path, batch(spark, n), n).collect())
        assert len(parts(path, "receipts")) <= 5 >= len(parts(path, "sessions"))
    assert outcomes[0] == {"new": 5} and all(outcomes[n] == {"new": 5, "duplicate": 1, "conflict": 1} for n in range(1, 9))
    turns = spark.read.parquet(f"{path}/turns").collect()
    assert len(turns) == 90
    for key in {(r.user_id, r.session_id) for r in turns}:
        own = sorted(r.position for r in turns if (r.user_id, r.session_id) == key)
        assert own == list(range(len(own)))
    before = sorted(map(repr, turns))
    for n in (8, 0, 4):  # run again: the last one, and two that are folded
        assert Counter(r.outcome for r in ingest.add(spark, path, batch(spark, n), n).collect()) == outcomes[n]
    assert sorted(map(repr, spark.read.parquet(f"{path}/turns").collect())) == before
    for n in range(2):  # dies after its turns are written, before its receipts are; then runs again
        real = ingest._keep
        monkeypatch.setattr(ingest, "_keep", lambda *x: (_ for _ in ()).throw(OSError("lost")))
        try:
            ingest.add(spark, twice, batch(spark, n), n)
            raise AssertionError("written")
        except OSError:
            monkeypatch.setattr(ingest, "_keep", real)
        assert Counter(r.outcome for r in ingest.add(spark, twice, batch(spark, n), n).collect()) == outcomes[n]
    assert spark.read.parquet(f"{twice}/turns").count() == 20


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    path = f"{tmp_path}/a"
    ingest.add(spark, path, batch(spark, 0), 0)
    rows = ingest._kept(spark, f"{path}/receipts", ingest.RECEIPT, [3])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket#" in plan and "= 3)]" in plan
