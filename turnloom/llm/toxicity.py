"""Toxicity by weak supervision.

Voters are found, not written: words and word beginnings that mark toxic rows among the labelled
training rows, plus patterns over them (several voters at once, several hits, a high rate). A
generative model of the votes, fitted by expectation maximisation, estimates how often each
voter fires in either class and how far voters repeat each other, and gives every training row a
posterior label. A logistic regression on the voters' counts is trained on those posteriors and
scores every document.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the models are fitted on, taken in the order of a hash of doc_id.
TRAIN_ROWS = 20_000
#: Lexicon voters, and how many candidates they are chosen from.
VOTERS = 64
CANDIDATES = 4_000
#: A candidate stands in this share of the toxic training rows, and in 3 of them, at least, and
#: its smoothed odds in toxic rows are this many times those in others.
LEAST_SHARE = 0.004
LEAST_ROWS = 3
LEAST_ODDS = 12.0
#: Characters of a word's beginning that are candidates; whole words are marked by "=".
STEMS = (4, 5, 6, 7)
#: Rounds before correlations are estimated, and the correlation from which votes repeat each other.
SETTLE = 10
REPEATS = 0.3
HELD_OUT = 2
THRESHOLD = 0.3

_WORD = re.compile(r"[^\W\d_]{4,}")


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 4 == HELD_OUT


def terms(text: str | None) -> list[str]:
    """The candidate terms of a text, with repeats: every word of four or more letters and its stems."""
    found = []
    for word in _WORD.findall((text or "").lower()):
        found.append("=" + word)
        found += [word[:k] for k in STEMS if len(word) >= k]
    return found


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """text, toxic of at most ``rows`` labelled rows outside the held-out quarter.

    Labels that are null don't count; a doc_id labelled twice counts as toxic if either says so.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # at most ``rows`` short rows
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def _term_counts(batches):
    from collections import Counter

    import pyarrow as pa

    for batch in batches:
        n, toxic = Counter(), Counter()
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            own = set(terms(text))
            n.update(own)
            if label:
                toxic.update(own)
        names = list(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([n[x] for x in names], pa.int64()), pa.array([toxic[x] for x in names], pa.int64())],
            names=["term", "n", "toxic"],
        )


def lexicon(train: DataFrame, voters: int = VOTERS) -> list[str]:
    """The voters' terms: those that single out toxic rows best, none inside another's word or stem."""
    total, toxic = train.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0))).first()
    if not toxic:
        return []
    counts = train.mapInArrow(_term_counts, "term string, n long, toxic long").groupBy("term")
    counts = counts.agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("toxic") + 0.5) / (total - toxic + 1))
    best = (
        counts.where(F.col("toxic") >= max(LEAST_ROWS, LEAST_SHARE * toxic))
        .withColumn("odds", odds)
        .where(F.col("odds") >= math.log(LEAST_ODDS))
        .orderBy((F.col("odds") * F.sqrt("toxic")).desc(), F.length("term"), "term")
        .limit(CANDIDATES)
    )
    chosen: list[str] = []
    for row in best.collect():  # at most CANDIDATES rows
        bare = row["term"].lstrip("=")
        if not any(bare.startswith(x.lstrip("=")) or x.lstrip("=").startswith(bare) for x in chosen):
            chosen.append(row["term"])
        if len(chosen) == voters:
            break
    return chosen


class Lexicon:
    """Counts of each term, and of words, in a text."""

    def __init__(self, chosen: list[str]):
        self.whole = {t[1:]: i for i, t in enumerate(chosen) if t[0] == "="}
        self.stems = {t: i for i, t in enumerate(chosen) if t[0] != "="}
        self.lengths = sorted({len(t) for t in self.stems})
        self.heads = {t.lstrip("=")[:4] for t in chosen}
        self.size = len(chosen)

    def counts(self, text: str | None) -> list[int]:
        out = [0] * (self.size + 1)
        words = _WORD.findall((text or "").lower())
        heads = self.heads
        for word in words:
            if word[:4] in heads:
                at = self.whole.get(word)
                if at is None:
                    at = next((self.stems[word[:k]] for k in self.lengths if word[:k] in self.stems), None)
                if at is not None:
                    out[at] += 1
        out[-1] = len(words)
        return out


def features(counts):
    """Counts (rows, terms + 1) as features: each term, all hits, distinct terms, hits a 1,000 words."""
    import numpy as np

    hits, words = counts[:, :-1].astype(float), counts[:, -1].astype(float)
    total = hits.sum(axis=1)
    rate = 1000 * total / np.maximum(words, 20)
    return np.column_stack([np.log1p(hits), np.log1p(total), (hits > 0).sum(axis=1), np.log1p(rate)])


def votes(counts):
    """1 where a voter votes, 0 where it abstains. Terms and the first patterns vote toxic; the
    last two, no hit and a lone hit in a long text, vote the other way."""
    import numpy as np

    hits, words = counts[:, :-1], counts[:, -1]
    total, distinct = hits.sum(axis=1), (hits > 0).sum(axis=1)
    toxic = [distinct >= 2, total >= 3, total * 1000 >= 5 * np.maximum(words, 20)]
    clean = [total == 0, (total == 1) & (words >= 400)]
    return np.column_stack([hits > 0, *toxic, *clean]).astype(float)


def label_model(v, prior: float, rounds: int = 50):
    """Posterior of the toxic class for each row of votes ``v``; an abstention is no evidence.

    How often each voter votes in either class is estimated by expectation maximisation, from a
    start at which a voter is believed. Votes that repeat each other within the classes are
    weighed down by their correlations, so ten copies of a voter count about as much as one.
    """
    import numpy as np

    n, m = v.shape
    posterior = np.where(v[:, :-2].any(axis=1) & ~v[:, -1].astype(bool), 0.9, 0.02)
    weight = np.full(m, 1.0)
    for turn in range(rounds):
        on, off = posterior.sum(), n - posterior.sum()
        p1 = (posterior @ v + 0.5) / (on + 1)
        p0 = ((1 - posterior) @ v + 0.5) / (off + 1)
        if turn == SETTLE:  # before that, doubt about the class would look like correlation
            rest = v - (posterior[:, None] * p1 + (1 - posterior)[:, None] * p0)
            scale = np.sqrt((rest**2).mean(axis=0)) + 1e-9
            correlation = np.abs(rest.T @ rest / n / np.outer(scale, scale))
            np.fill_diagonal(correlation, 0)
            weight = 1 / (1 + np.where(correlation > REPEATS, correlation, 0).sum(axis=1))
        logit = math.log(prior / (1 - prior)) + v @ (weight * np.log(p1 / p0))
        before, posterior = posterior, 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if turn > SETTLE and np.abs(posterior - before).max() < 1e-6:
            break
    return posterior


def logistic(x, y, ridge: float = 1.0, rounds: int = 30):
    """Weights and bias of a ridge logistic regression on soft labels, by Newton's method."""
    import numpy as np

    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(
            (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ w
        )
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


@dataclass
class Model:
    """The fitted scorer: its terms, weights and bias. ``weights`` is empty if nothing was learnt."""

    terms: list[str]
    weights: list[float]
    bias: float


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, voters: int = VOTERS) -> Model:
    """Fit on at most ``rows`` labelled rows; without a toxic label every score is 0."""
    import numpy as np

    train = training_rows(docs, labels, rows).cache()
    chosen = lexicon(train, voters)
    if not chosen:
        train.unpersist()
        return Model([], [], -math.inf)

    def count(batches):
        import pyarrow as pa

        words = Lexicon(chosen)
        for batch in batches:
            made = [words.counts(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(made, pa.list_(pa.int32())), batch.column("toxic").cast(pa.int32())], names=["c", "toxic"]
            )

    seen = train.mapInArrow(count, "c array<int>, toxic int").collect()  # at most ``rows`` short rows
    train.unpersist()
    order = sorted(seen, key=lambda r: (r["c"], r["toxic"]))
    counts = np.array([r["c"] for r in order], "int64")
    prior = min(max(sum(r["toxic"] > 0 for r in order) / len(order), 0.001), 0.5)
    posterior = label_model(votes(counts), prior)
    weights, bias = logistic(features(counts), posterior)
    return Model(chosen, [float(x) for x in weights], bias)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row of ``docs``; a null or empty text gets the score of no hit.

    Columns beside doc_id and text are not read; repeated rows get equal scores.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        words, weights = Lexicon(model.terms), np.array(model.weights)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            score = np.zeros(len(texts))
            if len(weights) and texts:
                counts = np.array([words.counts(x) for x in texts], "int64")
                score = 1 / (1 + np.exp(-np.clip(features(counts) @ weights + model.bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double"
    )
