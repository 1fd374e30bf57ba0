import hashlib
import math
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from turnloom.llm import alignment, bpe, centroids, licenses, queries
from turnloom.llm.common import arrow_rows

FILES = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
AWKWARD = ["a▁b", "<|endoftext|> x", "<s> <unk> <0x41>", "ﬁ ½ é​", "  two  blanks ", "\x00a\t\r\n", "漢字とかな", "x", " ", "🙂🙂 naïve", "İstanbul's don't"]


# --- alignment ---------------------------------------------------------------------------


def plain_alignment(rows):
    """Measures by doc_id of each row, with the ids of the ``tokenizers`` and ``sentencepiece`` libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    chars = {c: b for b, c in enumerate(_byte_characters())}
    entry = {i: bytes(chars[c] for c in tok) if all(c in chars for c in tok) else None for tok, i in t.get_vocab().items()}
    sp = sentencepiece.SentencePieceProcessor(model_file=FILES[2])

    def piece(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()

    made, holders = [], Counter()
    for doc, text in rows:
        a, b = [], []
        if text:
            a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            want = (" " + text).encode()
            if b"".join(entry[i] for i in a) != want or b"".join(map(piece, b)) != want:
                a, b = [], []
        spans = []
        for ids, size in ((a, entry.get), (b, piece)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(size(i)), i))
                at = own[-1][1]
            spans.append(own)
        links, k = [], 0
        for lo, hi, i in spans[0]:
            while k < len(spans[1]) and spans[1][k][1] <= lo:
                k += 1
            links += [(i, y) for x, z, y in spans[1][k : k + hi - lo + 1] if x < hi and lo < z]
        cuts = sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]})
        parts, start = [], 0
        for cut in cuts:
            parts.append("|".join(",".join(str(i) for lo, hi, i in own if start <= lo and hi <= cut) for own in spans))
            start = cut
        made.append((doc, len(a), len(b), len(cuts), links, ";".join(parts)))
        holders.update(set(links))
    most = defaultdict(int)
    for (i, _), n in holders.items():
        most[i] = max(most[i], n)
    return Counter(
        (doc, n_a, n_b, g, len(links), sum(holders[x] == most[x[0]] for x in links), sum(holders[x] for x in links),
         hashlib.sha256(s.encode()).hexdigest() if n_a else "")
        for doc, n_a, n_b, g, links, s in made
    )


def _byte_characters():
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def test_alignment_equals_the_libraries(spark, odd, docs):
    arrow_rows(spark, 7)
    short = docs.where("length(text) < 2500").select("doc_id", "text")
    extra = spark.createDataFrame([(900 + i, x) for i, x in enumerate(AWKWARD * 2)], "doc_id long, text string")
    trimmed = odd.select("doc_id", F.substring("text", 1, 3000).alias("text"))
    df = short.unionByName(trimmed).unionByName(extra)
    got = Counter(tuple(r) for r in alignment.alignment_measures(df, *FILES).collect())
    assert got == plain_alignment([tuple(r) for r in df.collect()])


def test_alignment_takes_odd_tables(odd, empty):
    assert alignment.alignment_measures(odd, *FILES).count() == odd.count()
    assert alignment.alignment_measures(empty, *FILES).count() == 0


def test_aligned_groups_spell_the_texts(spark, odd):
    enc = alignment.encoders(*FILES)
    rows = alignment.aligned(odd, *FILES, out="score").collect()
    for r in rows:
        a, b = [i for g in r.score for i in g.a], [i for g in r.score for i in g.b]
        assert (a, b) == tuple(enc(r.text))
        at = 0
        for g in r.score:
            part = enc.side_a.spell(g.a)
            at += len(part)
            assert part == enc.side_b.spell(g.b) and g.end == at
    assert len(rows) == odd.count()


def test_alignment_of_two_million_characters():
    enc = alignment.encoders(*FILES)
    for text in ("word " * 400_000, "x" * 2_000_000):
        a, b = enc(text)
        assert enc.side_a.spell(a) == (" " + text).encode() == enc.side_b.spell(b)
    made = alignment.Batch(enc, ["ab " * 100_000, None, "cd"])
    assert made.n_a.sum() == len(made.a) and made.n_groups[1] == 0


def test_both_rank_files_give_one_encoding(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = [" " + (r.text or "") for r in docs.collect()] + [" " + x for x in AWKWARD]
    enc = bpe.encoding(*FILES[:2])
    assert [bpe.encode_text(enc, x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


# --- centroids ---------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    mid = [v for _, v in order[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), i) for i, c in enumerate(mid))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        mid = [[sum(x) // len(own[i]) for x in zip(*own[i])] if i in own else c for i, c in enumerate(mid)]
    return Counter((i, near(v)[1], near(v)[0]) for i, v in kept), mid


def _embeddings(spark, dims=3):
    import random

    random.seed(5)
    rows = [(i, [random.randint(-3, 3) / 256 for _ in range(dims)]) for i in range(60)]  # many ties
    rows += [(7, [0.5] * dims), (7, [0.5] * dims), (None, [0.25] * dims), (None, None), (80, None), (81, []), (82, [1.0] * (dims + 1))]
    rows += [(83, [float("nan")] * dims), (84, [1.0, None, 1.0]), (85, [float("inf"), 0.0, 0.0]), (86, [-100.123, 99.9, 0.0])]
    return spark.createDataFrame([(i, v, None, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster string, distance string")


@pytest.mark.parametrize("k", [1, 4, 9, 500])
def test_clusters_equal_plain_ones(spark, k):
    df = _embeddings(spark)
    made = centroids.clustered(df, k=k, rounds=3, dims=3)
    want, mid = plain_clusters([(r.vec_id, r.embedding) for r in df.collect()], k, 3, 3)
    assert made.centroids == mid
    assert Counter((r.vec_id, r.cluster, r.distance) for r in made.rows.collect()) == want
    row = centroids.described(made).first()
    assert row.inertia == sum(d * n for (_, _, d), n in want.items())


def test_the_walk_is_exact_and_skips_centroids():
    import numpy as np

    rng = np.random.default_rng(1)
    mid = rng.integers(-2000, 2000, (40, 2))
    vectors = np.concatenate([rng.integers(-2500, 2500, (3000, 2)), mid])
    number, far, computed = centroids.Lists(mid).nearest(vectors)
    every = ((vectors[:, None] - mid[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()
    assert computed < every.size / 2


def test_no_vectors_and_large_components(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.described(centroids.clustered(none)).count() == 0
    huge = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        centroids.clustered(huge)


# --- licenses ----------------------------------------------------------------------------

MIT = licenses.TEMPLATES[2][1]


def plain_words(text):
    out, own = [], ""
    for c in (text or "") + " ":
        c = c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c
        if c > "\x7f" or c in "0123456789abcdefghijklmnopqrstuvwxyz":
            own += c
        elif own:
            out, own = [*out, own], ""
    return out


def plain_hits(words, gram=licenses.GRAM):
    found = set()
    for number, (_, text) in enumerate(licenses.TEMPLATES):
        own = plain_words(text)
        for q in range(len(own) - gram + 1):
            found |= {(number, p, q) for p in range(len(words) - gram + 1) if words[p : p + gram] == own[q : q + gram]}
    return found


def plain_spans(words, gram=licenses.GRAM):
    """(template, first, last, share) by going along the diagonals of each template."""
    votes = defaultdict(set)
    for number, p, q in plain_hits(words):
        votes[number, p - q].add(q)
    spans = []
    for number in {x[0] for x in votes}:
        size = len(plain_words(licenses.TEMPLATES[number][1]))
        rows = sorted((d + min(qs), d, d + max(qs) + gram - 1, qs) for (n, d), qs in votes.items() if n == number)
        open_, last_d, end = None, None, None
        for first, d, last, qs in rows:
            if open_ is None or abs(d - last_d) > math.ceil(size / 4) or first > end + licenses.GAP:
                open_, end = [number, first, last, set()], last
                spans.append((open_, size))
            open_[2] = end = max(end, last)
            open_[3] |= {q + j for q in qs for j in range(gram)}
            last_d = d
    return [(n, a, b, len(c) / size) for (n, a, b, c), size in spans]


def plain_scan(doc, text):
    words = plain_words(text)
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at, base = [p for p, _ in places], {x for _, x in places}
    spans = plain_spans(words)
    place, more, reach = [], set(), -1
    for n, first, last, share in sorted((s for s in spans if s[3] >= licenses.MIN_SHARE), key=lambda s: (s[1], s[2], s[0])) + [(None, math.inf, 0, 0)]:
        if first > reach:
            more |= {licenses.TEMPLATES[m][0] for m, x in place if x == max(y for _, y in place)}
            place = []
        place.append((n, share))
        reach = max(reach, last)
    score = 1.0 if places else max([s for *_, s in spans], default=0.0)
    return doc, len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score


LICENSED = [
    (1, MIT), (2, "x " + MIT.replace("any person", "any natural or legal person") + " y"), (3, MIT[: len(MIT) // 2]),
    (4, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0."), (5, "Under the MIT-license; Apache License, Version 2.0\nUNDER THE MIT LICENSE"),
    (6, "This work is licensed under the GNU General Public License, version 3."), (7, "under the the mit license under the mit"), (7, None), (None, MIT),
    (8, "\n".join([MIT] * 3)), (9, MIT.replace(" ", "  ").upper()), (10, "É under é the mit license É"),
]


def test_scan_equals_a_plain_one(spark, odd, docs):
    arrow_rows(spark, 5)
    extra = spark.createDataFrame(LICENSED, "doc_id long, text string")
    some = docs.where("text rlike '(?i)licen'").select("doc_id", "text")
    df = extra.unionByName(odd.select("doc_id", "text")).unionByName(some)
    got = Counter(tuple(r) for r in licenses.scanned(df).collect())
    assert got == Counter(plain_scan(r.doc_id, r.text) for r in df.collect())


def test_scan_labels(spark):
    rows = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame([x for x in LICENSED if x[0] != 7], "doc_id long, text string")).collect()}
    assert [rows[i].labels for i in (1, 2, 3, 4, 5, 6)] == ["mit", "mit", "", "cc-by-nc", "apache-2,mit", "gpl-3"]
    assert rows[2].score == 1 and 0 < rows[3].score < licenses.MIN_SHARE and rows[4].n_base == 2 and rows[8].labels == "mit"
    at = {(r.doc_id, r.label): r for r in licenses.located(spark.createDataFrame(LICENSED, "doc_id long, text string")).collect()}
    assert at[2, "mit"].first_word == 1


def test_scan_of_odd_tables(odd, empty):
    rows = licenses.scanned(odd.withColumn("tag", F.lit(1)).withColumn("label", F.lit("x")))
    assert rows.count() == odd.count()
    assert licenses.scanned(empty).count() == 0


def test_two_million_characters():
    words = licenses.parted("Under the MIT License, " * 90_000).split()
    assert len(licenses._phrase_places(words, licenses.PHRASES)) == 90_000


def test_registered_queries_return_the_contract(spark, sf):
    for name, columns in {
        "op11_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
        "op12_centroids": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
        "op13_licenses": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    }.items():
        assert queries.QUERIES[name](spark, sf).columns == columns
