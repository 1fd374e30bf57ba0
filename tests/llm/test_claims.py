from collections import Counter

from turnloom.llm import substring

CLAIMS = "sdoc long, scopy long, spos int, len int, words string"


def test_claims_on_one_source_are_not_put_together(spark):
    """Many different claims on one long source, some false, one beyond its end."""
    words = [f"w{k * 7919 % 1000}" for k in range(1500)]
    spans = [(s, n) for s in range(0, 700, 7) for n in (13, 64, 130, 700)]
    rows = [(1, 0, s, n, " ".join(words[s : s + n])) for s, n in spans]
    wrong = [(1, 0, 100, 200, " ".join([*words[100:299], "other"])), (1, 0, 1480, 30, " ".join([*words[1480:], *["more"] * 10])), (2, 0, 0, 13, "x " * 12 + "x")]
    claims = spark.createDataFrame(rows + wrong, CLAIMS)
    texts = [(1, 0, " ".join(words)), (2, 1, "x " * 12 + "x"), (3, 0, None)]
    texts = spark.createDataFrame(texts, "doc_id long, copy long, text string").mapInArrow(substring._packed, "doc_id long, copy long, z binary")
    found = substring.false_pieces(claims, texts)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.sdoc, r.block * substring.BLOCK + r["at"], r.n, r.words.split(" ")[-1]) for r in found.collect()}
    assert got == {(1, 256, 44, "other"), (1, 1480, 30, "more"), (2, 0, 13, "x")}


def test_pieces_are_bounded_and_whole(spark):
    words = [f"w{k}" for k in range(1000)]
    rows = [(1, 0, s, n, " ".join(words[s : s + n])) for s in range(0, 300, 3) for n in (13, 128, 129, 650)]
    pieces = spark.createDataFrame(rows, CLAIMS).mapInArrow(substring._pieces, substring.PIECE_ROWS).collect()
    assert max(len(r.words.split(" ")) for r in pieces) <= substring.BLOCK
    assert sum(r.n for r in pieces) == sum(r[3] for r in rows)
    assert all(r.words.split(" ") == words[r.block * 64 + r["at"] :][: r.n] for r in pieces)
    assert max(Counter((r.sdoc, r.block) for r in set(pieces)).values()) < len(rows) / 4
