import hashlib
from collections import Counter

from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from turnloom.llm import exact, simhash, substring


def plain(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def low(text):
    return (text or "").encode().lower().decode()


# --- substring ---------------------------------------------------------------------------


def brute_substring(rows):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            if i is not None:
                key = tuple(w[k : k + 13])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        keep = [True] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                keep[k : k + 13] = [False] * 13
        kept = b" ".join(x for x, ok in zip(w, keep, strict=True) if ok)
        out.append((i, len(w), len(w) - sum(keep), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_substring_equals_brute_force(docs):
    assert Counter(map(tuple, substring.deduplicated(docs).collect())) == brute_substring(plain(docs))


def test_substring_with_colliding_hashes_and_compaction(docs):
    found = substring.deduplicated(docs, batches=3, fanout=1, bits=12)
    assert Counter(map(tuple, found.collect())) == brute_substring(plain(docs))


def test_substring_odd_rows(odd, empty):
    assert Counter(map(tuple, substring.deduplicated(odd).collect())) == brute_substring(plain(odd))
    assert substring.deduplicated(empty).count() == 0


def test_standing_index_takes_later_batches(spark, docs):
    """Four batches over a reopened index equal brute force over all; runs are compacted on the way."""
    parts = [docs.where(F.floor(F.col("doc_id") / 60) == k) for k in range(3)] + [docs.where("doc_id >= 180")]
    index = substring.SubstringIndex(spark, fanout=2)
    made = [index.add(x) for x in parts[:2]]
    index = substring.SubstringIndex.open(spark, index.path)
    assert len(index.runs["prints"]) == 2 and index.seq == 2
    made += [index.add(x) for x in parts[2:]]
    assert len(index.runs["prints"]) == len(index.runs["texts"]) == 2 and index.seq == 4
    old, new = map(spark.table, index.runs["prints"])
    assert len(old.inputFiles()) <= index.buckets and len(spark.table(index.runs["texts"][0]).inputFiles()) <= index.buckets
    # Spark takes a union of bucketed scans for bucketed, which it isn't; the index doesn't rely on it.
    with substring._settings(spark):
        rows = old.unionByName(new).groupBy("fp").count()
        assert rows.count() == rows.select("fp").distinct().count()
        plan = old.join(new.hint("merge"), "fp")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort [" not in plan  # the runs are merged as they are
    got = Counter(tuple(r)[:1] + tuple(r)[2:] for x in made for r in x.collect())
    assert got == brute_substring(plain(docs))
    index.close()


def test_index_orders_by_batch_then_id(spark):
    """A later batch gives way to an earlier one, whatever the ids; a document sent again isn't its own source."""
    same = " ".join(f"w{k}" for k in range(20))
    index = substring.SubstringIndex(spark)
    one = index.add(spark.createDataFrame([(10, same), (11, same)], "doc_id long, text string"))
    two = index.add(spark.createDataFrame([(3, same + " end"), (10, same), (None, same), (12, "x " + same)], "doc_id long, text string"))
    assert {(r.doc_id, r.n_removed) for r in one.collect()} == {(10, 0), (11, 20)}
    assert {(r.doc_id, r.n_removed) for r in two.collect()} == {(3, 20), (10, 0), (None, 0), (12, 20)}
    index.close()


def test_runs_are_sorted_once_and_merged_without_a_sort(spark, docs):
    import pyarrow.parquet as pq

    def written(since):
        """The plans that wrote a table from execution ``since`` on."""
        store = spark._jsparkSession.sharedState().statusStore()
        found = store.executionsList()
        plans = [found.apply(k) for k in range(found.size()) if found.apply(k).executionId() >= since]
        return [x.physicalPlanDescription().split("Initial Plan")[0] for x in plans if "CreateDataSourceTableAsSelect" in x.physicalPlanDescription()]

    def last():
        found = spark._jsparkSession.sharedState().statusStore().executionsList()
        return max((found.apply(k).executionId() for k in range(found.size())), default=-1)

    index = substring.SubstringIndex(spark, fanout=2)
    since = last() + 1
    for rest in (0, 1):
        index.add(docs.where(F.col("doc_id") % 2 == rest))
    adding = written(since)
    since = last() + 1
    index.compact()
    merging = written(since)
    for kind, (keys, _) in substring.KINDS.items():
        (run,) = index.runs[kind]
        for file in spark.table(run).inputFiles():
            rows = list(zip(*(pq.read_table(file.removeprefix("file:")).column(k).to_pylist() for k in keys), strict=True))
            assert rows == sorted(rows)
    index.close()
    assert len(adding) == 4 and all(x.count(" Sort (") == 1 and "pmod" not in x for x in adding)
    assert len(merging) == 2 and not any(" Sort (" in x for x in merging)



# --- exact -------------------------------------------------------------------------------


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    out = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        for k, i in enumerate(sorted(ids, key=lambda x: (x is None, x))):
            out[(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


def test_exact_equals_brute_force(docs, odd, empty):
    for df in (docs, odd):
        rows = exact.dedup(df).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.digest) for r in rows) == brute_exact(plain(df))
        kept = Counter(r.digest for r in rows if r.kept)
        assert set(kept.values()) == {1} and set(kept) == {r.digest for r in rows}
        assert all(r.doc_id == r.keep_id for r in rows if r.kept)
    assert exact.dedup(empty).count() == 0


def test_exact_tells_collisions_apart(docs):
    weak = lambda norm: F.left(F.sha2(norm, 256), F.lit(1))
    found = exact.dedup(docs, weak).collect()
    want = {(i, keep, n) for i, keep, n, _ in brute_exact(plain(docs))}
    assert {(r.doc_id, r.keep_id, r.group_size) for r in found} == want


def test_exact_state_lasts_over_segments(spark, docs):
    from turnloom.llm.common import shared_dir

    store, rows = shared_dir(spark, "segments"), docs.select("doc_id", "text")
    for name, part in (("a", "doc_id % 2 = 0"), ("b", "doc_id % 2 = 1")):
        exact.land(rows.where(part), store, name)
        exact.advance(spark, store, rows.schema)
        exact.advance(spark, store, rows.schema)  # nothing new: nothing is counted twice
    found = exact.resolve(spark, store, rows.schema)
    got = Counter((r.at.doc_id, r.keep.doc_id, r.group_size, r.digest) for r in found.collect())
    assert got == brute_exact(plain(docs))


def test_survivors_keep_one_whole_row_of_each_text(odd):
    rows = exact.survivors(odd).collect()
    assert Counter(low(r.text) for r in rows) == Counter({low(t) for _, t in plain(odd)})
    assert rows[0].__fields__ == odd.columns


# --- SimHash -----------------------------------------------------------------------------


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    values = sorted({f for _, f in fps})
    root = {f: f for f in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(values):
        for b in values[k + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(b)] = find(a)
    least = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return Counter((i, f"{f:016x}", least.get(find(f))) for i, f in fps)


def test_simhash_equals_brute_force(docs, odd, empty):
    for df in (docs, odd):
        rows = simhash.near_duplicates(df).select("doc_id", simhash.hex16("fp").alias("f"), "component_id")
        assert Counter(map(tuple, rows.collect())) == brute_components(plain(df))
    assert simhash.near_duplicates(empty).count() == 0


def test_nodes_split_again_when_they_are_large(spark):
    import random

    random.seed(3)
    base = [random.getrandbits(64) for _ in range(40)]
    values = {b ^ sum(1 << random.randrange(64) for _ in range(random.randrange(4))) for b in base for _ in range(25)}
    df = spark.createDataFrame([(simhash.signed(x),) for x in values], "fp long")

    def edges(node_rows):
        roots = {r.a: r.root for r in simhash.components(simhash.links(df, node_rows)).collect()}
        return Counter(Counter(roots.get(simhash.signed(x), simhash.signed(x)) for x in values).values())

    assert edges(8192) == edges(20)


def test_few_links_take_few_tasks_however_many_shuffle_partitions(spark):
    fps = spark.createDataFrame([(1 << b,) for b in range(3, 40)] + [(0xFFFF << b,) for b in range(0, 40, 8)], "fp long").coalesce(2)
    path = spark.createDataFrame([(k, k + 1) for k in range(50)], "a long, b long").coalesce(2)
    context, before = spark.sparkContext, {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(before, ("211", "false"), strict=True):
        spark.conf.set(k, v)
    context.setJobGroup("few-links", "few links")
    try:
        linked = simhash.components(simhash.links(fps)).collect()
        walked = {(r.a, r.root) for r in simhash.components(path).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(linked) == 36 and walked == {(k, 0) for k in range(1, 51)}  # 2 ** b all link, the others don't
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few-links") for s in tracker.getJobInfo(j).stageIds}
    assert sum(max(x.numCompletedTasks for x in [tracker.getStageInfo(s)]) for s in stages if tracker.getStageInfo(s)) < 1500


def test_links_of_all_nodes_are_merged_within_bounds(monkeypatch):
    import numpy as np
    import pyarrow as pa

    fps = np.arange(1 << 18, dtype="i8") // 2 * 1024  # nodes of two: each is linked to itself only
    fps[1::2] += 1  # and to its neighbour
    columns = [pa.array(np.zeros(1 << 18, "i8")), pa.array(np.arange(1 << 18) // 2), pa.array(fps)]
    batches = [pa.RecordBatch.from_arrays(columns, names=["mask", "value", "fp"])] * 3
    for edges in (1 << 20, 1 << 10):
        monkeypatch.setattr(simhash, "EDGES", edges)
        out = list(simhash._link_partitions(iter(batches)))
        pairs = {(a, b) for x in out for a, b in zip(*(c.to_pylist() for c in x.columns), strict=True)}
        assert pairs == {(k * 1024 + 1, k * 1024) for k in range(1 << 17)}
        assert sum(x.num_rows for x in out) == (1 << 17) * (1 if edges == 1 << 20 else 3)


def test_tree_finds_the_pairs_that_brute_force_finds():
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 30, dtype="u8")
    fps = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 63, 30, dtype="u8")) for _ in range(12)]))
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    i, j = simhash.tree_pairs(fps)
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if int(fps[a] ^ fps[b]).bit_count() <= 4}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
