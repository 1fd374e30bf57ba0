import random
from collections import defaultdict

from pyspark.sql import functions as F

from tests.plain_retrieval import lexical, scores
from tests.test_similar_blocks import shuffled
from turnloom.operators import scoring

WORDS = "boat tea lamp river stone garden painting market winter letter".split()


def tables(seed=2):
    rng, questions, candidates = random.Random(seed), [], []
    for q in range(8):
        questions.append((q, " ".join(rng.choices(WORDS, k=3)) if q != 6 else "the and of"))
        for place, i in enumerate(rng.sample(range(100), (60, 9, 1, 0, 55, 30, 12, 50)[q])):
            candidates.append((q, i, place, " ".join(rng.choices([*WORDS, "filler", "other"], k=rng.randint(0, 9)))))
    return questions, candidates


def value(q, content):
    """The made-up scorer's mind: letters of the passage, beyond the scale at times; nothing on some."""
    if q == 7 or content.startswith("river") or not content:
        return None
    return len(content) % 14 - 2.0


def scorer(seen):
    def run(asked):
        rows = asked.collect()  # the tables are small; a real scorer works in the tasks
        seen.append(rows)
        size = defaultdict(int)
        for r in rows:
            size[r.query_id, r.batch] += 1
        # in company a passage of "lamp" fails its batch's second half, alone it doesn't
        out = [(r.query_id, r.id, value(r.query_id, r.content)) for r in rows if size[r.query_id, r.batch] == 1 or "lamp" not in r.content]
        return asked.sparkSession.createDataFrame(out, "query_id long, id long, score double")

    return run


def plain(questions, candidates, known, k):
    made = {}
    for q, text in questions:
        own = sorted((p, i, c) for n, i, p, c in candidates if n == q)
        lex = scores([(i, lexical(c)) for _, i, c in own], lexical(text), 1.5)
        ranked = sorted(own, key=lambda x: (-lex.get(x[1], 0.0), x[0]))
        good, some = [], False
        for n, (p, i, c) in enumerate(ranked):
            if n >= scoring.SCORED:
                good.append((0.0, 2, p, i))
                continue
            s, group = (known[q, i], 1) if (q, i) in known else (value(q, c), 0)
            if s is not None:
                some = True
                good.append((-min(10.0, max(0.0, s)), group, n, i))
        if some:
            rows = [(i, -s, "scored") for s, _, _, i in sorted(good)[:k]]
        else:
            best = max(lex.values(), default=0)
            rows = [(i, None, "keyword") for p, i, _ in (ranked if best > 0 else own) if best <= 0 or lex.get(i, 0) >= 0.5 * best][:k]
        made |= {(q, n): x for n, x in enumerate(rows, 1)}
    return made


def test_order_and_fallback_equal_plain_python(spark):
    questions, candidates = tables()
    known = {(q, i): float(i % 12) for q, i, _, _ in candidates if i % 5 == 0 and q != 7}
    q = spark.createDataFrame(questions, "query_id long, query string")
    c = spark.createDataFrame(candidates, "query_id long, id long, place long, content string")
    held = spark.createDataFrame([(*k, s) for k, s in known.items()], "query_id long, id long, score double")
    for table, facts in ((held, known), (None, {})):
        seen = []
        got = {(r.query_id, r["rank"]): (r.id, r.score, r.mode) for r in scoring.by_usefulness(c, q, scorer(seen), 8, table).collect()}
        assert got == plain(questions, candidates, facts, 8)
        assert {m for *_, m in got.values()} == {"scored", "keyword"}
        first, again = seen[0], seen[1]
        sizes = defaultdict(int)
        for r in first:
            sizes[r.query_id, r.batch] += 1
            assert (r.query_id, r.id) not in facts
        assert max(sizes.values()) == scoring.BATCH and len({(r.query_id, r.batch) for r in again}) == len(again)
        assert max(sum(r.query_id == n for r in first) for n in range(8)) <= scoring.SCORED
    new = {(r.query_id, r.id): r.score for r in scoring.scored(c, q, scorer([]), held).collect()}
    assert new.items() >= known.items() and len(new) > len(known)
    assert scoring.by_usefulness(c.limit(0), q, scorer([])).count() == 0


def test_proofs(spark):
    q = spark.createDataFrame([(1, False), (2, True), (3, None), (4, False), (5, True)], "query_id long, gaps boolean")
    s = spark.createDataFrame([(1, 4.0), (2, 4.9), (3, 99.0), (5, 5.0)], "query_id long, score double")
    got = {r.query_id: (r.proves, r.score, r.mode) for r in scoring.proofs(q, s).collect()}
    assert got == {1: (True, 4.0, "prove"), 2: (False, 4.9, "abstain"), 3: (True, 9.0, "prove"), 4: (True, 5.0, "skipped"), 5: (True, 5.0, "prove")}


def test_a_scorer_in_the_tasks(spark, sf):
    from turnloom.plans import catalog

    catalog.load()
    rows = catalog.QUERIES["usefulness_scored"](spark, sf).collect()
    assert rows and {r.mode for r in rows} <= {"scored", "keyword"} and max(r["rank"] for r in rows) <= 8


def test_words_that_no_question_asks_for_are_not_shuffled(spark):
    texts = [(q, n, n, " ".join(f"word{chr(97 + n % 26)}{chr(97 + k)}x" + "yz" * j for j in range(6) for k in range(26))) for q in (1, 2) for n in range(40)]
    rows = spark.createDataFrame(texts, "query_id long, id long, place long, content string")
    asked = spark.createDataFrame([(1, "wordabx wordbcx"), (2, "nothing of it")], "query_id long, query string")
    before = shuffled(spark)
    got = {(r.query_id, r["rank"]): r.id for r in scoring.by_usefulness(rows, asked, lambda a: a.select("query_id", "id", F.lit(1.0).alias("score"))).collect()}
    # of all texts those with a word asked for come first among equal scores
    assert [got[1, n] for n in (1, 2, 3, 4, 5)] == [0, 1, 26, 27, 2] and [got[2, n] for n in (1, 2)] == [0, 1]
    assert shuffled(spark) - before < 80 * 40
