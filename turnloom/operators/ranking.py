"""Ranked and boolean text search, and vector search, for many queries at once.

Scores are rounded to nine digits before ranking, so the order of a sum's terms can't decide a rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from turnloom.sources.shared import shared_dir, ship, written


def postings(docs: DataFrame, keys: list[str], terms: str) -> DataFrame:
    """keys, term, tf: ``terms`` is an array column; repeated terms count."""
    return docs.select(*keys, F.explode(terms).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(
    docs: DataFrame,
    queries: DataFrame,
    scope: str,
    doc: str,
    query: str,
    k1: float = 1.5,
    b: float = 0.75,
    least_length: int = 0,
    idf_floor: float | None = None,
) -> DataFrame:
    """query, doc, score (unrounded) of every pair that shares a term.

    ``docs`` has scope, doc and terms (array), ``queries`` has query, scope and terms. The
    statistics are those of a scope. A term that a query repeats counts as often. Documents of a
    scope that share no term get no row. Of a document only the terms that some query of its scope
    asks for become rows, and these meet on (scope, term). Where ``docs`` has ``size``, that is the
    length and ``terms`` may lack what no query asks for.
    """
    length = F.greatest(F.col("size") if "size" in docs.columns else F.size("terms"), F.lit(least_length)).alias("dl")
    totals = docs.select(scope, length).groupBy(scope).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean"))
    asked = postings(queries, [query, scope], "terms").withColumnRenamed("tf", "qtf")
    wanted = asked.groupBy(F.col(scope).alias("__scope")).agg(F.collect_set("term").alias("__asked"))
    own = docs.select(scope, doc, "terms", length).join(wanted, F.col(scope) == F.col("__scope"))
    # terms become rows before they are looked up, as a lambda over them is not compiled
    own = own.select(scope, doc, "dl", "__asked", F.explode("terms").alias("term")).where(F.array_contains("__asked", F.col("term")))
    found = own.groupBy(scope, doc, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    frequency = found.groupBy(scope, "term").agg(F.count(F.lit(1)).alias("df"))
    weighted = weights(asked.join(frequency, [scope, "term"]), totals, scope, idf_floor)
    return found.join(weighted, [scope, "term"]).groupBy(query, doc).agg(F.sum(part(k1, b)).alias("score"))


def weights(terms: DataFrame, totals: DataFrame, scope: str, idf_floor: float | None = None) -> DataFrame:
    """``terms`` (with scope and df) with idf and mean from ``totals`` (scope, n, mean)."""
    totals = totals.withColumn("mean", F.when(F.col("mean") == 0, 1.0).otherwise(F.col("mean")))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    if idf_floor is not None:
        idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(idf_floor))
    return terms.join(totals, scope).withColumn("idf", idf).drop("df", "n")


def part(k1: float, b: float):
    """What one term of a query adds to a document's score."""
    return F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("mean")))


def top(rows: DataFrame, by: str, k: int, *order) -> DataFrame:
    """The first ``k`` rows of each ``by`` in ``order``, with ``rank`` from 1."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def ranked_turns(turns: DataFrame, queries: DataFrame, terms, k: int = 20, column: str = "text", least_length: int = 0) -> DataFrame:
    """The ``k`` turns of each query's user that fit best; turns without a shared term rank last.

    Ties go to the earlier turn in the history's order: ``turns`` has user_id, arrival, ``column``
    and ``place``; ``queries`` has query_id, user_id and query. Only turns that share a term are
    scored; a query that has fewer than ``k`` of them is filled from its user's first 2 * k turns,
    so a history isn't joined with its queries as a whole.
    """
    docs = turns.join(queries.select("user_id").distinct(), "user_id", "left_semi").select("user_id", "arrival", terms(F.col(column)).alias("terms"))
    # kept, as it is counted, and read for each term that is asked for
    docs = written(docs, shared_dir(turns.sparkSession, "terms"))
    asked = queries.select("query_id", "user_id", terms(F.col("query")).alias("terms"))
    return filled(bm25(docs, asked, "user_id", "arrival", "query_id", least_length=least_length), turns, queries, k)


def filled(scores: DataFrame, turns: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of ``scores`` (query_id, arrival, score), with its user's first turns where
    a query has fewer."""
    scored = scores.join(turns.select("user_id", "arrival", "place"), "arrival").withColumn("score", F.round("score", 9))
    scored = top(scored, "query_id", k, F.desc("score"), "place", "arrival").drop("rank")
    first = top(turns.select("user_id", "arrival", "place"), "user_id", 2 * k, "place", "arrival").drop("rank")
    spare = queries.select("query_id", "user_id").join(first, "user_id").withColumn("score", F.lit(0.0))
    rows = scored.unionByName(spare).groupBy("query_id", "user_id", "arrival").agg(F.max("score").alias("score"), F.max("place").alias("place"))
    return top(rows, "query_id", k, F.desc("score"), "place", "arrival")


def best_or_first(docs: DataFrame, asked: DataFrame, scope: str, doc: str, query: str, k: int, share: float = 0.5) -> DataFrame:
    """query, doc, score, place, rank: what is at least ``share`` of the best fit, ``k`` at most; the
    first ``k`` of its scope for a query that fits none.

    ``docs`` has scope, doc, terms and place (from 1), ``asked`` query, scope and terms; both may
    name the same column as scope and query.
    """
    docs, asked = docs.withColumn("within", F.col(scope)), asked.withColumn("within", F.col(scope))
    scores = bm25(docs.select("within", doc, "terms"), asked.select(query, "within", "terms"), "within", doc, query, least_length=1)
    placed, who = docs.select("within", doc, "place"), asked.select(query, "within")
    rows = scores.join(who, query).join(placed, ["within", doc]).withColumn("score", F.round("score", 9))
    spare = who.join(placed.where(F.col("place") <= k), "within").withColumn("score", F.lit(0.0))
    rows = rows.unionByName(spare).withColumn("best", F.max("score").over(Window.partitionBy(query)))
    rows = rows.where((F.col("best") <= 0) | ((F.col("score") > 0) & (F.col("score") >= share * F.col("best"))))
    return top(rows, query, k, F.desc("score"), "place", doc).drop("best", "within")


def select_best(ranked: DataFrame, by: str, share: float = 0.5, k: int = 8) -> DataFrame:
    """Rows of at least ``share`` of their query's best score, ``k`` at most; if the best is no
    more than 0, the first ``k`` in input order. Has ``score``, ``place`` and ``arrival``."""
    best = F.max("score").over(Window.partitionBy(by))
    rows = ranked.withColumn("best", best).where((F.col("best") <= 0) | (F.col("score") >= share * F.col("best")))
    hit = F.when(F.col("best") > 0, F.col("score")).otherwise(0.0)
    return top(rows.withColumn("hit", hit), by, k, F.desc("hit"), "place", "arrival").drop("hit", "best")


def all_terms(docs: DataFrame, queries: DataFrame, scope: str, doc: str, query: str) -> DataFrame:
    """query, doc of the documents that have every term of the query (distinct terms in ``terms``)."""
    asked = queries.select(query, scope, F.size("terms").alias("n"), F.explode("terms").alias("term"))
    held = docs.select(scope, doc, F.explode(F.array_distinct("terms")).alias("term"))
    met = asked.join(held, [scope, "term"]).groupBy(query, doc, "n").agg(F.count(F.lit(1)).alias("m"))
    return met.where("m = n").select(query, doc)


def cosine(a, b):
    """Cosine of two float arrays in double; -1 if empty, of unequal length or without a norm."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v
    )
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(-1.0))


#: Query vectors that meet all vectors in one pass, numbers of a block of vectors, cells of a table of
#: scores that a task makes at a time, and what a fast score may be off by, with the rounding.
QUERY_BLOCK, NUMBERS, CELLS, SLACK = 10_000, 1 << 19, 1 << 21, 2e-6


def _packed(rows: DataFrame, id_col: str, column: str) -> DataFrame:
    """block, ids, vectors: ``rows`` in blocks, numbered within a partition."""
    ids, kind = rows.schema[id_col].dataType, rows.schema[column].dataType
    made = StructType([StructField("block", LongType()), StructField("ids", ArrayType(ids)), StructField("vectors", ArrayType(kind))])
    schema = to_arrow_schema(made)

    def pack(batches):
        number = 0
        for batch in batches:
            step = max(1, NUMBERS * batch.num_rows // max(1, len(batch.column(1).flatten())))
            for at in range(0, batch.num_rows, step):
                cut = batch.slice(at, step)
                lists = [pa.ListArray.from_arrays(pa.array([0, cut.num_rows], pa.int32()), x) for x in cut.columns]
                cols = [pa.array([number], pa.int64()), *lists]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)
                number += 1

    return rows.select(id_col, column).mapInArrow(pack, made)


class _Vectors:
    """The vectors of a block by their sizes; only those in ``good`` have a cosine. """

    def __init__(self, ids, vectors):
        self.ids, self.size, self.norm = ids, np.zeros(len(ids), np.int64), np.zeros(len(ids))
        self.good, self.at, self.rows = np.zeros(len(ids), bool), np.zeros(len(ids), np.int64), {}
        size = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0))
        for n in np.unique(size[size > 0]):
            own = np.flatnonzero(size == n)
            held = vectors.take(pa.array(own)).flatten()
            whole = np.asarray(held.is_valid()).reshape(-1, n).all(1)
            rows = held.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
            with np.errstate(over="ignore", invalid="ignore"):
                norm = np.sqrt(_in_order(rows * rows))
            self.size[own], self.norm[own] = n, norm
            self.good[own], self.at[own], self.rows[int(n)] = whole, np.arange(len(own)), rows


def _in_order(products):
    """Sums of rows from left to right, as ``cosine`` adds."""
    return np.cumsum(products, axis=1)[:, -1]


def _scores_of(a: _Vectors, b: _Vectors, x, y):
    """``cosine`` to the last bit for rows ``x`` of one block with rows ``y`` of another."""
    made = np.full(len(x), -1.0)
    fits = a.good[x] & b.good[y] & (a.size[x] == b.size[y])
    for n in np.unique(a.size[x[fits]]):
        which = np.flatnonzero(fits & (a.size[x] == n))
        for own in np.array_split(which, -(-len(which) * n // CELLS)):
            dot = _in_order(a.rows[n][a.at[x[own]]] * b.rows[n][b.at[y[own]]])
            norm = a.norm[x[own]] * b.norm[y[own]]
            made[own] = np.where((norm > 0) | np.isnan(norm), dot / norm, -1.0)
    return made


def _near(a: _Vectors, b: _Vectors, k: int, best, order):
    """Rows of ``a``, rows of ``b`` and scores that may be among the ``k`` best of ``a``, given the ``k``
    ``best`` scores so far, which are brought up to date. ``order`` has the places of both's ids.
    Where a norm may overflow, vanish or be no number, no fast score counts."""
    mine, other = order
    plain_a, plain_b = (s.good & (s.norm > 1e-150) & (s.norm < 1e150) for s in (a, b))
    odd_a, odd_b = (s.good & ~p & (s.norm != 0) for s, p in ((a, plain_a), (b, plain_b)))
    found, step = [], max(1, CELLS // max(1, len(b.ids)))
    for low in range(0, len(a.ids), step):
        s = slice(low, min(low + step, len(a.ids)))
        fast = np.full((s.stop - low, len(b.ids)), -1.0)
        for n in a.rows.keys() & b.rows.keys():
            i = low + np.flatnonzero((a.size[s] == n) & plain_a[s])
            j = np.flatnonzero((b.size == n) & plain_b)
            one, two = (v.rows[n][v.at[r]] / v.norm[r][:, None] for v, r in ((a, i), (b, j)))
            fast[np.ix_(i - low, j)] = one @ two.T
        odd = odd_a[s][:, None] | odd_b
        differ = mine[s][:, None] != other
        fast[~differ | odd] = -np.inf
        both = np.concatenate([best[s], fast], axis=1)
        best[s] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        x, y = np.nonzero(differ & (odd | (fast >= best[s].min(1)[:, None] - SLACK)))
        x, score = x + low, _scores_of(a, b, x + low, y)
        # of equal scores the first k ids are enough
        sort = np.lexsort((other[y], score, x))
        x, y, score = x[sort], y[sort], score[sort]
        same = (x[1:] == x[:-1]) & ((score[1:] == score[:-1]) | (np.isnan(score[1:]) & np.isnan(score[:-1])))
        start = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(x)), 0)) if len(x) else x
        keep = np.arange(len(x)) - start < k
        found.append((x[keep], y[keep], score[keep]))
    return [np.concatenate(z) for z in zip(*found)]


def _nearest(k: int, kind):
    """What compares the two blocks of each row; a task keeps the best scores of its query blocks."""

    def nearest(batches):
        best = {}
        for batch in batches:
            for n in range(batch.num_rows):
                a, b = (_Vectors(batch.column(f"{s}_ids")[n].values, batch.column(f"{s}_vectors")[n].values) for s in ("a", "b"))
                block = batch.column("a_block")[n].as_py()
                if block not in best:
                    best[block] = np.full((len(a.ids), k), -np.inf)
                ids = [s.ids.to_numpy(zero_copy_only=False) for s in (a, b)]
                place = np.unique(np.concatenate(ids), return_inverse=True)[1]
                with np.errstate(all="ignore"):
                    x, y, score = _near(a, b, k, best[block], (place[: len(a.ids)], place[len(a.ids) :]))
                cols = [a.ids.take(pa.array(x)), b.ids.take(pa.array(y)), pa.array(score)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, kind)], schema=kind)

    return nearest


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, vec_id, rank, score: the ``k`` nearest of all other ``vectors`` for each query vector.

    Every stated query meets every vector once, block by block: a pass over the vectors for each
    ``block`` queries. A product of matrices tells which pairs may be among the best, and these get
    the score that ``cosine`` gives. Nothing is broadcast; tasks keep only the best of their own
    rows, so what is shuffled is the queries and ``k`` rows for each query and task.
    """
    ship(vectors.sparkSession)
    passes = -(-queries.count() // block) or 1
    own = queries.where("query_id IS NOT NULL").repartition(passes, "query_id")
    named = lambda df, side: df.select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns))
    a, b = named(_packed(own, "query_id", "q"), "a"), named(_packed(vectors.where("vec_id IS NOT NULL"), "vec_id", "embedding"), "b")
    made = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("vec_id", vectors.schema["vec_id"].dataType), StructField("score", DoubleType())])
    rows = b.join(a.hint("shuffle_replicate_nl")).mapInArrow(_nearest(k, to_arrow_schema(made)), made)
    rows = rows.withColumn("score", F.round("score", 6)).select("query_id", "vec_id", "score")
    return top(rows, "query_id", k, F.desc("score"), "vec_id")
