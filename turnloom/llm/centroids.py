"""Clustering around centroids, with nearest centroids found by a threshold algorithm.

For each dimension the centroids stand in a list sorted by their component. A vector walks each
list outward from its own component: a step takes, in every dimension, the nearest centroid not
walked past yet. What is seen for the first time gets its exact distance. The squared gaps of one
step, summed over the dimensions, bound the distance of every centroid that no list has shown
yet, so the walk stops once that sum is over the best exact distance: strictly, since a centroid
at the same distance may have a smaller number. All arithmetic is on integers.

A round sends the centroids (k x dimensions, parameters) to the tasks and gets back sums by
cluster, added up in each task before any are shuffled. Vectors are never shuffled or collected.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import staged

DIMENSIONS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
SEED = 2

#: Components beyond this, once scaled, could overflow the squared distance as a long.
LARGEST = 1 << 27
#: Parts in which the tasks' sums of a cluster are added up before the driver gets them.
BLOCKS = 64
#: Vectors that walk at a time.
SLICE = 4096


class Lists:
    """The sorted lists of a set of centroids."""

    def __init__(self, centroids):
        import numpy as np

        self.centroids = np.asarray(centroids, "i8")
        self.order = np.argsort(self.centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(self.centroids, self.order, axis=0)

    def nearest(self, vectors):
        """Number and squared distance of the nearest centroid of each vector (ties: the smaller
        number), and how many exact distances were computed."""
        import numpy as np

        k, dims = self.centroids.shape
        n, every = len(vectors), np.arange(dims)
        best = np.full(n, np.iinfo("i8").max)
        number, seen, computed = np.full(n, k), np.zeros((n, k), bool), 0
        right = np.empty((n, dims), "i8")
        for j in every:
            right[:, j] = np.searchsorted(self.values[:, j], vectors[:, j])
        left, rows = right - 1, np.arange(n)
        end = np.int64(1) << 40  # further than any gap, and its square is not summed
        for _ in range(k):
            own = vectors[rows]
            below = np.where(left >= 0, own - self.values[np.maximum(left, 0), every], end)
            above = np.where(right < k, self.values[np.minimum(right, k - 1), every] - own, end)
            lower = below <= above
            gap = np.where(lower, below, above)
            found = self.order[np.where(lower, left, right), every]
            new = np.zeros((len(rows), k), bool)
            new[np.arange(len(rows))[:, None], found] = True
            new &= ~seen[rows]
            seen[rows] |= new
            for c in np.flatnonzero(new.any(axis=0)):  # in ascending order, so that ties keep the smaller
                at = rows[new[:, c]]
                away = vectors[at] - self.centroids[c]
                far = np.einsum("ij,ij->i", away, away)
                computed += len(at)
                better = (far < best[at]) | ((far == best[at]) & (c < number[at]))
                best[at[better]], number[at[better]] = far[better], c
            going = (gap * gap).sum(axis=1) <= best[rows]
            going &= ~seen[rows].all(axis=1)
            if not going.any():
                break
            left, right = left - lower, right + ~lower
            left, right, rows = left[going], right[going], rows[going]
        return number, best, computed


def scaled(column, dims: int = DIMENSIONS):
    """Which entries of an Arrow list column are vectors of ``dims`` finite components, and these
    as integers."""
    import numpy as np

    lists = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    sizes = np.asarray(lists.value_lengths().fill_null(-1))
    rows = np.flatnonzero(sizes == dims)
    flat = lists.take(rows).flatten()
    raw = np.asarray(flat.fill_null(float("nan")), "f8").reshape(-1, dims)
    good = np.isfinite(raw).all(axis=1)
    whole = np.floor(raw[good] * SCALE)
    if (np.abs(whole) >= LARGEST).any():
        raise ValueError(f"a component is too large for exact distances (limit: {LARGEST // SCALE})")
    return rows[good], whole.astype("i8")


def _vectors(df: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    kept = "vec_id long, v array<bigint>"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows, whole = scaled(batch.column(1), dims)
            lists = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype="i4") * dims, pa.array(whole.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), lists], names=["vec_id", "v"])

    return df.select(F.col(id_col).cast("long"), vector_col).mapInArrow(run, kept)


def seeds(df: DataFrame, k: int = CLUSTERS, dims: int = DIMENSIONS, id_col: str = "vec_id", vector_col: str = "embedding") -> list:
    """The ``k`` vectors with the smallest hash of their id, in that order; fewer if there are
    fewer. Rows of one id stand in the order of their components, rows without one come last."""
    order = (F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), F.col("v"))
    return [x.v for x in _vectors(df, id_col, vector_col, dims).orderBy(*order).limit(k).collect()]


def assigned(df: DataFrame, centroids: list, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, n_computed of every vector; n_computed is the number of exact
    distances of its slice, given with the first vector of the slice and 0 for the others."""
    dims = len(centroids[0]) if centroids else DIMENSIONS

    def run(batches):
        import numpy as np
        import pyarrow as pa

        lists = Lists(centroids) if centroids else None
        for batch in batches:
            rows, whole = scaled(batch.column(1), dims)
            for at in range(0, len(rows), SLICE):
                number, far, computed = lists.nearest(whole[at : at + SLICE])
                share = np.zeros(len(number), "i8")
                share[0] = computed
                ids = batch.column(0).take(rows[at : at + SLICE])
                columns = [ids, pa.array(number, pa.int32()), pa.array(far), pa.array(share)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "n_computed"])

    rows = df.select(F.col(id_col).cast("long"), vector_col)
    return rows.mapInArrow(run, "vec_id long, cluster int, distance long, n_computed long")


def moved(df: DataFrame, centroids: list, vector_col: str = "embedding") -> list:
    """The centroids after one round: componentwise floor of the mean of their vectors; one
    without vectors stays."""
    dims, names = len(centroids[0]), [f"s{j}" for j in range(len(centroids[0]))]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        lists, k = Lists(centroids), len(centroids)
        counts, sums = np.zeros(k, "i8"), np.zeros((k, dims), "i8")
        for batch in batches:
            _, whole = scaled(batch.column(0), dims)
            for at in range(0, len(whole), SLICE):
                part = whole[at : at + SLICE]
                number, _, _ = lists.nearest(part)
                order = np.argsort(number, kind="stable")
                own, first = np.unique(number[order], return_index=True)
                sums[own] += np.add.reduceat(part[order], first, axis=0)
                counts += np.bincount(number, minlength=k)
        own = np.flatnonzero(counts)
        columns = [pa.array(own, pa.int32()), pa.array(counts[own]), *(pa.array(sums[own, j]) for j in range(dims))]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", *names])

    schema = "cluster int, n long, " + ", ".join(f"{x} long" for x in names)
    parts = df.select(vector_col).mapInArrow(run, schema)
    # a row of each cluster from each task, added up by blocks of tasks; the driver gets k x 64 rows
    block = F.pmod(F.spark_partition_id(), F.lit(BLOCKS))
    half = parts.groupBy("cluster", block.alias("block")).agg(*(F.sum(x).alias(x) for x in ("n", *names)))
    total = {}
    for row in half.collect():
        total[row.cluster] = [x + y for x, y in zip(total.get(row.cluster, [0] * (dims + 1)), row[2:], strict=True)]
    return [[x // total[i][0] for x in total[i][1:]] if i in total else list(c) for i, c in enumerate(centroids)]


@dataclass
class Clustering:
    centroids: list
    rows: DataFrame


def clustered(
    df: DataFrame,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    dims: int = DIMENSIONS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> Clustering:
    """The centroids after ``rounds`` rounds, and vec_id, cluster, distance, n_computed of every
    vector by them, written to the shared folder.

    Vectors with another number of components, a null or a non-finite one are left out, as are
    null vectors. Repeated rows and rows of one id are vectors of their own; a null id is kept and
    starts a centroid only if too few vectors have one. With fewer vectors than ``k`` each starts
    one; without any the result is empty. Other columns are not read. A component of 2 ** 19 or
    more raises, as its squared distances might not fit a long.
    """
    centroids = seeds(df, k, dims, id_col, vector_col)
    for _ in range(rounds if centroids else 0):
        centroids = moved(df, centroids, vector_col)
    rows = assigned(df, centroids, id_col, vector_col)
    return Clustering(centroids, staged(rows, "clusters"))


def described(made: Clustering) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector."""
    spark = made.rows.sparkSession
    sums = made.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    own, total = {x.cluster: int(x.s) for x in sums}, sum(int(x.s) for x in sums)
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [(i, own[i], total, digest(c)) for i, c in enumerate(made.centroids) if i in own]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row for each of k centroids
    return made.rows.drop("n_computed").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", *about.columns[1:])
