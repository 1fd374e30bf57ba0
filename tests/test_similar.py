import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from turnloom.operators import similar
from turnloom.streaming import derived


def plain_pairs(sets, share):
    """Every two different sets of a scope, by definition; the least id stands for equal ones."""
    first = {}
    for (scope, i), own in sorted(sets.items()):
        if own:
            first.setdefault((scope, frozenset(own)), i)
    stands = [(scope, i, own) for (scope, own), i in first.items()]
    return {(s, min(i, j), max(i, j)) for s, i, a in stands for t, j, b in stands if s == t and i < j and len(a & b) * 1000 >= share * 1000 * len(a | b)}


@pytest.mark.parametrize("share", [0.25, 0.4, 0.6, 0.7, 0.8, 1.0])
def test_every_pair_of_documents(spark, sf, share):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL")
    rows = docs.select(F.lit(0).alias("scope"), F.col("doc_id").alias("id"), similar.token_set(F.col("text")).alias("tokens"))
    sets = {(0, r.id): set(r.tokens) for r in rows.collect()}
    assert all(own == {t for t in r.text.lower().split() if len(t) > 2} for r in docs.collect() for own in [sets[0, r.doc_id]])
    want = plain_pairs(sets, share)
    got = [(r.scope, r.x, r.y) for r in similar.similar(rows, share).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert want or share == 1.0


def test_small_sets_ties_and_copies(spark):
    rng = random.Random(1)
    rows = [(n % 3, n, rng.sample("abcdefghij", rng.randint(0, 7))) for n in range(240)] + [(5, 1, ["q"]), (5, 2, ["q"]), (5, 3, []), (5, 4, ["r"])]
    df = spark.createDataFrame(rows, "scope long, id long, tokens array<string>")
    for share in (0.25, 0.5, 0.75):
        got = {(r.scope, r.x, r.y): r.overlap for r in similar.similar(df, share).collect()}
        sets = {(s, i): set(t) for s, i, t in rows}
        assert got.keys() == plain_pairs(sets, share)
        assert all(o == round(len(sets[s, x] & sets[s, y]) / len(sets[s, x] | sets[s, y]), 6) for (s, x, y), o in got.items())
    members = {(r.scope, r.id): r.class_id for r in similar.classes(df).collect()}
    assert members[5, 2] == 1 and (5, 3) not in members and members[5, 4] == 4
    assert similar.similar(df.limit(0), 0.5).count() == 0


# --- views that are kept up ---------------------------------------------------------------

SAID = ["I use {} paint for the {} boat on the river", "My {} was cold and the {} boat was on the river", "We were at the {} market and I have a {} lamp.",
        "I always prefer {} tea over {} coffee in the morning", "Nothing here", "I was ill yesterday with {} and {} at home"]


def turns(seed=6, n=120):
    rng, rows = random.Random(seed), []
    for arrival in range(n):
        body = " ".join(rng.choice(SAID).format(rng.choice(["red", "green", "old"]), rng.choice(["new", "small", "grey"])) + rng.choice([". ", "!\n", " "]) for _ in range(rng.randint(1, 3)))
        session = rng.randint(0, 5)
        rows.append((session // 2, session, arrival, arrival % 7, None if session == 1 else 1_700_000_000 + rng.randint(0, 9) * 86400, None if arrival == 17 else body))
    return rows


SCHEMA = "user_id long, session_id long, arrival long, position long, said_at long, body string"
KEPT = [v for v in derived.VIEWS if v not in ("sets", "prefixes")]


def contents(views):
    return {name: sorted(map(repr, views.read(name).collect())) for name in KEPT}


def plain_views(rows, spark):
    """Conflicts and supersessions of all claims at once, by definition."""
    claims = derived.claims(spark.createDataFrame(rows, SCHEMA)).collect()
    words = {c.id: {t for t in c.text.lower().split() if len(t) > 2} for c in claims}
    conflicts, closed = set(), set()
    for new in claims:
        for old in claims:
            if old.id < new.id and old.user_id == new.user_id and old.session_id == new.session_id:
                a, b = words[new.id], words[old.id]
                share = len(a & b) / len(a | b) if a | b else 0
                if share < 0.4:
                    continue
                pair = (new, old)
                if share >= 0.7:
                    known = all(abs(c.valid_from - c.ts) > 1 for c in pair)
                    pair = (old, new) if known and new.valid_from < old.valid_from else pair
                    closed.add((new.user_id, pair[1].id, pair[0].id, pair[0].valid_from, new.id, round(share, 6)))
                conflicts.add((new.user_id, pair[0].id, pair[1].id, new.entity or new.text[:80], round(share, 6)))
    return conflicts, closed


def test_any_split_of_the_turns_gives_the_same_views(spark, tmp_path):
    rows = turns()
    frame = lambda part: spark.createDataFrame(part, SCHEMA)
    whole = derived.DerivedViews(spark, f"file://{tmp_path}/whole", 4)
    assert whole.apply("all", frame(rows)) and not whole.apply("all", frame(rows))
    want = contents(whole)
    conflicts, closed = plain_views(rows, spark)
    assert {tuple(r) for r in whole.read("conflicts").collect()} == conflicts and conflicts
    assert {tuple(r) for r in whole.read("supersessions").collect()} == closed and closed
    assert len(want["claims"]) == len(want["timeline"]) == len(set(want["claims"]))
    mixed = rows[:]
    random.Random(2).shuffle(mixed)
    parts = derived.DerivedViews(spark, f"file://{tmp_path}/parts", 4)
    for n, part in enumerate((mixed[:50], mixed[50:51], mixed[51:90], mixed[90:])):
        parts.apply(f"b{n}", frame(part + part[:2]))
        if n == 2:
            before = contents(parts)
            parts.compact()
            assert contents(parts) == before
            assert not parts.apply("b1", frame(part))
    assert contents(parts) == want
    again = derived.DerivedViews(spark, f"file://{tmp_path}/parts", 4)
    assert contents(again) == want
    assert {name: df.count() for name, df in again.changes("b3").items()}["claims"] > 0
    open_ = {r.id for r in again.current().collect() if r.valid_to is None}
    assert open_ == {r.id for r in whole.read("claims").collect()} - {c[1] for c in closed}


def test_a_batch_reads_its_users_only(spark, tmp_path):
    views = derived.DerivedViews(spark, f"file://{tmp_path}/v", 8)
    views.apply("a", spark.createDataFrame(turns(), SCHEMA))
    bucket = spark.createDataFrame([(0,)], "user_id long").select(views._bucket().alias("b")).first().b
    rows = views.read("prefixes", [bucket])
    assert {r.user_id for r in rows.select("user_id").distinct().collect()} >= {0}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket#" in plan and f"= {bucket})]" in plan


def test_batches_without_claims(spark, tmp_path):
    views = derived.DerivedViews(spark, f"file://{tmp_path}/v", 4)
    none = spark.createDataFrame([], SCHEMA)
    assert views.apply("a", none) and views.apply("b", spark.createDataFrame(turns()[:9], SCHEMA)) and views.apply("c", none)
    assert views.read("claims").count() > 0
