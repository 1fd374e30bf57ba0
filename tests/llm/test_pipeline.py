from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from turnloom.llm import quality, simhash
from turnloom.llm.common import staged


def test_stages_on_brute_force(spark, docs, sf, odd, empty):
    rows = staged(corpus_pipeline.quality_rules(spark, docs, sf), "q")
    want = {}
    for r in docs.collect():
        q = dict(zip(quality.QUALITY.names, quality.assess(r.text), strict=True))
        if q["kept"]:
            want[r.doc_id] = q["cleaned"]
    assert {r.doc_id: r.text for r in rows.collect()} == want
    assert rows.columns == docs.columns and all(r.n_chars == len(r.text) for r in rows.collect())

    rows = staged(corpus_pipeline.exact_dedup(spark, rows, sf), "e")
    last = {}
    for i, t in want.items():
        key = t.encode().lower()
        last[key] = max(i, last.get(key, i))
    assert {r.doc_id for r in rows.collect()} == set(last.values())
    assert rows.columns == docs.columns

    from tests.llm.test_dedup import brute_components

    before = {r.doc_id: r.text for r in rows.collect()}
    rows = staged(corpus_pipeline.near_dedup(spark, rows, sf), "n")
    stay = {c for _, _, c in brute_components(list(before.items()))}
    assert {r.doc_id for r in rows.collect()} == stay

    rows = staged(corpus_pipeline.pseudonyms(spark, rows, sf), "p")
    assert {r.doc_id for r in rows.collect()} == stay and rows.columns == docs.columns

    packed = corpus_pipeline.best_fit_packing(spark, rows, sf).collect()
    assert {r.doc_id for r in packed} == stay

    whole = corpus_pipeline.run(spark, sf).collect()
    key = lambda rows: Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)
    assert key(whole) == key(packed)


def test_stages_with_odd_and_empty_tables(spark, sf, odd, empty):
    for df in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, df, sf).columns == df.columns
            stage(spark, df, sf).collect()
        corpus_pipeline.STAGES[-1][1](spark, df, sf).collect()


def test_stages_keep_clashing_columns_and_judge_rows(spark, sf, odd):
    """Names that the stages use come back with their values; rows of one id are judged one by one."""
    from turnloom.llm import exact
    from tests.llm import plain_pii
    from turnloom.llm.queries import PII_KEY

    for name in ("__id", "__at", "__quality", "__found", "__made", "at", "quality", "found", "made", "tag", "own_id", "own_tag", "n_pii", "file", "row"):
        odd = odd.withColumn(name, F.concat(F.lit(name), F.col("doc_id")))
    names = [c for c in odd.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    values = lambda r: tuple(r[c] for c in names)
    rows = odd.collect()
    want = Counter()
    for r in rows:
        q = dict(zip(quality.QUALITY.names, quality.assess(r.text), strict=True))
        if q["kept"]:
            want[(r.doc_id, q["cleaned"], values(r))] += 1
    got = Counter((r.doc_id, r.text, values(r)) for r in corpus_pipeline.quality_rules(spark, odd, sf).collect())
    assert got == want

    low = lambda t: (t or "").encode().lower()
    number = lambda i: -1 if i is None else i
    best = {}
    for r in rows:
        best[low(r.text)] = max(best.get(low(r.text), -1), number(r.doc_id))
    got = Counter((low(r.text), number(r.doc_id)) for r in corpus_pipeline.exact_dedup(spark, odd, sf).collect())
    assert got == Counter(best.items())
    assert all(values(r) == values(next(x for x in rows if x.doc_id == r.doc_id)) for r in corpus_pipeline.exact_dedup(spark, odd, sf).collect())
    assert exact.SEGMENTS > 1

    from tests.llm.test_dedup import brute_components

    named = brute_components([(r.doc_id, r.text) for r in rows])
    stay = {(i, fp) for i, fp, c in named if i == c}
    fp = lambda t: f"{simhash.fingerprint(t):016x}"
    want = Counter((r.doc_id, r.text, values(r)) for r in rows if (r.doc_id, fp(r.text)) in stay)
    assert Counter((r.doc_id, r.text, values(r)) for r in corpus_pipeline.near_dedup(spark, odd, sf).collect()) == want

    want = Counter((r.doc_id, plain_pii.pseudonymised(PII_KEY, r.text)[0], values(r)) for r in rows)
    assert Counter((r.doc_id, r.text, values(r)) for r in corpus_pipeline.pseudonyms(spark, odd, sf).collect()) == want
