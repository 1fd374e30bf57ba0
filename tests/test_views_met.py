"""Claims that come in batches: compared by sessions in memory, no candidate pairs shuffled."""

import random

import pytest

from turnloom.operators import similar
from turnloom.streaming import derived


@pytest.mark.parametrize("block", [similar.BLOCK, 40])
def test_batches_meet_where_they_lie(spark, monkeypatch, block):
    """Pairs of fresh rows, and of fresh with stored ones, by definition; a scope may have many blocks."""
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "LIGHT", 1)
    rng = random.Random(7)
    rows = [(n % 2, n % 4 // 2, n, rng.choice([None, f"t{n}"]), rng.sample(range(12), rng.randint(1, 8)), n % 3 > 0) for n in range(160)]
    rows += [(5, 0, 900, "lone", [1, 2], True), (6, 0, 901, "old", [1, 2], False), (6, 0, 902, "old", [1, 2], False)]
    df = spark.createDataFrame(rows, "u long, s long, id long, topic string, hashes array<long>, fresh boolean")
    got = similar.met(df.where("fresh"), df.where("NOT fresh"), 0.4, ["u", "s"], {"topic": "string"}).collect()
    want = {}
    for a in rows:
        for b in rows:
            both = len(set(a[4]) & set(b[4]))
            either = len(set(a[4]) | set(b[4]))
            if a[:2] == b[:2] and a[2] < b[2] and (a[5] or b[5]) and both * 5 >= either * 2:
                want[a[2], b[2]] = (both, either, a[3], b[3])
    key = lambda r: (r.x, r.y, r.x_topic, r.y_topic) if r.x < r.y else (r.y, r.x, r.y_topic, r.x_topic)
    made = {key(r)[:2]: (r.both, r.either, *key(r)[2:]) for r in got}
    assert len(got) == len(made) and made == want and want


def test_views_shuffle_no_candidate_pairs(spark, tmp_path):
    """Claims that share half of their tokens without contradicting leave nothing behind but themselves."""
    body = lambda n: "I use " + " ".join(f"{w}{'x' if w == 'same' else n}" for w in ("same", "red", "green", "grey", "old"))
    rows = [(1, 1, n, n, None, body(n)) for n in range(300)]
    views = derived.DerivedViews(spark, f"file://{tmp_path}/v", 4)
    views.apply("a", spark.createDataFrame(rows, "user_id long, session_id long, arrival long, position long, said_at long, body string"))
    assert views.read("claims").count() == 300 and views.read("conflicts").count() == 0
    assert sorted(x.name for x in (tmp_path / "v").iterdir() if x.is_dir()) == sorted(derived.VIEWS)
    assert views.read("prefixes").count() == 300  # one row for each claim, not for each token
