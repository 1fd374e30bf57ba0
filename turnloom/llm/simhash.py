"""SimHash near-duplicates by a Gray-order hierarchical index.

The upper nodes of the index are shared masked bit patterns: the 64 bits are cut into six
blocks, and each of the 15 pairs of blocks is a mask. Fingerprints at four or fewer differing
bits agree on at least two whole blocks, so every link lies under a common upper node. Under a
node the fingerprints are sorted by Gray rank and grouped, each group keeping the bits all its
members share; groups of groups are compared from the top, the differences found in shared bits
accumulate on the way down, and a pair of groups is dropped as a whole once they exceed four.

A node with more than NODE_ROWS fingerprints is split again by pairs of blocks of its free bits,
which is exact for the same reason; four levels leave fewer than 8,192 possible values, so no
node can outgrow a task. Only a spanning forest of the links under a node is kept, never all
pairs, and a task merges those of all its nodes into one. Components are found on what tasks
leave by alternating large and small stars.

Steps over few rows run in as many tasks as their rows ask for, not in one for each shuffle
partition (see ``_dealt``): a turn of stars is all overhead where partitions are many and edges few.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import shared_dir, staged

MAX_BITS = 4
BLOCKS = 6
SHINGLE = 4
SEED = 42
#: Fingerprints under one node of the index before it is split again.
NODE_ROWS = 8192
#: Members of a group, and of a group of groups.
FAN = 16
#: Rows of a task in steps over fingerprints and links, and links that a task merges at a time.
TASK_ROWS = 1 << 20
EDGES = 1 << 20

ALL = (1 << 64) - 1


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def child_masks(mask: int) -> list[int]:
    """The masks under ``mask``: its bits and two of six blocks of the bits it leaves free."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [round(i * len(free) / BLOCKS) for i in range(BLOCKS + 1)]
    blocks = [sum(1 << b for b in free[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
    return [mask | a | b for a, b in combinations(blocks, 2)]


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint: bit b is 1 if set in over half the shingles' hashes."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # of bytes, lower() maps A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        starts = [0, *ends]
        hashes = [xxh64_intdigest(joined[s : e - 1], seed) for s, e in zip(starts, ends[shingle - 1 :], strict=False)]
    ones, n = np.zeros(64, "int64"), len(hashes)
    values = np.array(hashes, "<u8")
    for at in range(0, n, 65536):
        part = values[at : at + 65536]
        ones += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and the columns ``carry``, one row for each row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [signed(fingerprint(x, shingle, seed)) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(made, pa.int64()), *map(batch.column, carry)], names=["doc_id", "fp", *carry]
            )

    kept = docs.select(*carry)
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    return docs.mapInArrow(run, f"doc_id long, fp long{kinds}")


# --- under one node -------------------------------------------------------------------------


def _bits(x):
    import numpy as np

    return np.bitwise_count(x)


def gray_rank(x):
    """The place of each code in the reflected Gray order."""
    rank = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> shift
    return rank


def tree_pairs(fps, most: int = MAX_BITS):
    """Pairs (i < j) of rows of ``fps``, sorted by Gray rank, at ``most`` or fewer bits."""
    import numpy as np

    levels = [(fps, np.full(len(fps), ALL, "u8"))]  # (pattern, mask of the bits that all share)
    while len(levels[-1][0]) > FAN:
        pattern, mask = levels[-1]
        starts = np.arange(0, len(pattern), FAN)
        both = np.bitwise_and.reduceat(pattern, starts)
        some = np.bitwise_or.reduceat(pattern, starts)
        shared = np.bitwise_and.reduceat(mask, starts) & ~(both ^ some)
        levels.append((both & shared, shared))
    pattern, mask = levels[-1]
    i, j = np.triu_indices(len(pattern))
    i, j, sofar, known = i.astype("int64"), j.astype("int64"), np.zeros(len(i), "int64"), np.zeros(len(i), "u8")
    for depth in range(len(levels) - 1, -1, -1):
        pattern, mask = levels[depth]
        found_i, found_j = [], []
        next_sofar, next_known = [], []
        for at in range(0, len(i), 1 << 14):
            a, b, acc, seen = i[at : at + (1 << 14)], j[at : at + (1 << 14)], sofar[at : at + (1 << 14)], known[at : at + (1 << 14)]
            if depth < len(levels) - 1:
                fan = np.arange(FAN)
                a = (a[:, None, None] * FAN + fan[None, :, None] + 0 * fan[None, None, :]).ravel()
                b = (b[:, None, None] * FAN + 0 * fan[None, :, None] + fan[None, None, :]).ravel()
                acc, seen = np.repeat(acc, FAN * FAN), np.repeat(seen, FAN * FAN)
                ok = (a < len(pattern)) & (b < len(pattern)) & (a <= b)
                a, b, acc, seen = a[ok], b[ok], acc[ok], seen[ok]
            common = mask[a] & mask[b]
            acc = acc + _bits((pattern[a] ^ pattern[b]) & common & ~seen)
            ok = acc <= most
            found_i.append(a[ok])
            found_j.append(b[ok])
            next_sofar.append(acc[ok])
            next_known.append(common[ok])
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        sofar, known = np.concatenate(next_sofar), np.concatenate(next_known)
    ok = i < j
    return i[ok], j[ok]


def link_nodes(node, fps, most: int = MAX_BITS):
    """Links among rows sorted by (node, Gray rank): arrays of fingerprints a and their roots b < a."""
    import numpy as np

    n = len(fps)
    starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    sizes = np.diff(np.append(starts, n))
    us, vs = [], []
    large = sizes > 4 * FAN
    rows = np.arange(n)
    in_small = np.repeat(~large, sizes)
    ends = np.repeat(starts + sizes, sizes)
    for step in range(1, int(sizes[~large].max(initial=0))):
        rows = rows[(rows + step < ends[rows]) & in_small[rows]]
        near = rows[_bits(fps[rows] ^ fps[rows + step]) <= most]
        us.append(near)
        vs.append(near + step)
    for at, size in zip(starts[large], sizes[large], strict=True):
        i, j = tree_pairs(fps[at : at + size], most)
        us.append(i + at)
        vs.append(j + at)
    if not us:
        return fps[:0], fps[:0]
    return forest(fps[np.concatenate(us)], fps[np.concatenate(vs)])


def forest(a, b):
    """The links (a, b) as stars: arrays of every end that isn't its component's least, and that least."""
    import numpy as np

    values, index = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = index[: len(a)], index[len(a) :]
    root = np.arange(len(values))
    while True:
        least = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], least)
        np.minimum.at(root, root[v], least)
        np.minimum.at(root, u, least)
        np.minimum.at(root, v, least)
        root = root[root]
        if (root == before).all():
            break
    own = np.flatnonzero(root != np.arange(len(values)))
    return values[own], values[root[own]]


def _link_partitions(batches):
    """Rows (mask, value, fp) sorted by node come in; links go out. The last node of a batch
    waits for the next batch, so a node is never cut; a node has NODE_ROWS rows at most. The links
    of all nodes are merged into stars; over EDGES of them go out as they are then."""
    import numpy as np
    import pyarrow as pa

    held = None
    empty = True
    stars, n = [], 0

    def out(a, b):
        return pa.RecordBatch.from_arrays([pa.array(x.view("i8"), pa.int64()) for x in (a, b)], names=["a", "b"])

    for batch in batches:
        own = [batch.column(k).to_numpy(zero_copy_only=False).astype("i8") for k in range(3)]
        held = own if held is None else [np.concatenate(x) for x in zip(held, own, strict=True)]
        if not len(held[0]):
            continue
        empty = False
        last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
        cut = len(last) - int(last.sum())
        if cut >= 1 << 17:
            stars.append(_linked([x[:cut] for x in held]))
            n += len(stars[-1][0])
            held = [x[cut:] for x in held]
            if n > EDGES:
                stars = [forest(*map(np.concatenate, zip(*stars, strict=True)))]
                n = len(stars[0][0])
                if n > EDGES // 2:
                    yield out(*stars[0])
                    stars, n = [], 0
    if not empty:
        stars.append(_linked(held))
        yield out(*forest(*map(np.concatenate, zip(*stars, strict=True))))


def _linked(held):
    import numpy as np

    mask, value, fps = held
    node = np.cumsum(np.concatenate(([0], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1]))))
    return link_nodes(node, fps.view("u8"))


def _dealt(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a step over about ``rows`` rows, in a task for each TASK_ROWS of them, but no fewer than
    keep every core busy twice; never in more than it has partitions."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def links(distinct: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """(a, b) with b < a as unsigned: for every task, a spanning forest of the links under its nodes."""
    spark = distinct.sparkSession
    in_all = distinct.count() * len(child_masks(0))
    rows = distinct.select("fp", F.lit(0).cast("long").alias("mask"))
    parents, found, base = [0], None, shared_dir(spark, "simhash-index")
    rank = F.col("fp")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    for level in range(BLOCKS - 1):
        pairs = [(signed(p), signed(m)) for p in parents for m in child_masks(p)]
        if level == 0:
            masks = F.explode(F.array(*[F.lit(m) for _, m in pairs]))
            rows = rows.select("fp", masks.alias("mask"))
        else:  # as many rows as masks of this level, whatever the input
            below = spark.createDataFrame(pairs, "mask long, child long")
            rows = rows.join(F.broadcast(below), "mask").select("fp", F.col("child").alias("mask"))
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n"))
        large = staged(_dealt(sizes.where(F.col("n") > node_rows), in_all), "large", f"{base}/large-{level}")
        split = not large.isEmpty()
        own = rows.join(large.select("mask", "value"), ["mask", "value"], "left_anti") if split else rows
        made = (
            own.repartition("mask", "value")
            .select("mask", "value", "fp", rank.alias("rank"))
            .sortWithinPartitions("mask", "value", "rank")
            .select("mask", "value", "fp")
        )
        made = staged(_dealt(made, in_all).mapInArrow(_link_partitions, "a long, b long"), "links", f"{base}/links-{level}")
        found = made if found is None else found.unionByName(made)
        if not split:
            break
        rows = rows.join(large.select("mask", "value"), ["mask", "value"], "left_semi").select("fp", "mask")
        parents = [m & ALL for m in {m for _, m in pairs}]
    return found


def components(edges: DataFrame) -> DataFrame:
    """(a, root): every node of ``edges`` (a, b) that isn't its component's smallest, with the smallest.

    Alternating large and small stars; each turn is written to the shared folder, so a lost
    executor costs a part of one turn. It ends when every edge joins a node to its component's
    smallest. ``edges`` are read several times.
    """
    base = shared_dir(edges.sparkSession, "components")
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))

    def ended(df):
        """How many rows ``df`` has, and whether they are stars: no node has two parents or is one with a parent."""
        ends = df.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(df.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = _dealt(ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")), n)
        up, wrong = ends.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 1) | (F.col("up") + F.col("down") > 1))).first()
        return up, not wrong

    n = 0
    n, stars = ended(now)
    turn = 0
    while not stars:
        turn += 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # The minima are written first: a join of two plain shuffles can be split where a node has
        # many links, a join with an aggregation beside it can't.
        least = _dealt(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), n)
        least = staged(least, "least", f"{base}/{turn}-large")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _dealt(_dealt(large.where("a <> b"), n).distinct(), n)
        large = staged(large, "large", f"{base}/{turn}-edges")
        least = staged(_dealt(large.groupBy("a").agg(F.min("b").alias("m")), n), "least", f"{base}/{turn}-small")
        rest = _dealt(large.join(least, "a").where("b <> m"), n)
        rest = rest.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        now = least.withColumnRenamed("m", "b").unionByName(rest).distinct()
        now = staged(_dealt(now, n), "edges", f"{base}/{turn}")
        n, stars = ended(now)
    return now.select("a", F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, node_rows: int = NODE_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp, component_id and the columns ``carry`` of every row of ``docs``.

    Documents without words, null texts among them, have fingerprint zero, which links like any
    other. A null doc_id gets a row, but never names a component unless all its members are null.
    Repeated rows give repeated rows. Columns beside doc_id and text are not read.
    """
    fps = staged(fingerprints(docs, carry=carry), "fingerprints")
    n = fps.count()
    first = staged(_dealt(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), n), "distinct")
    roots = components(links(first.select("fp"), node_rows))
    named = first.join(roots, first["fp"] == roots["a"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    named = staged(_dealt(named, n), "rooted")
    least = staged(_dealt(named.groupBy("root").agg(F.min("first").alias("component_id")), n), "components")
    lone = staged(_dealt(named.join(least, "root").select("fp", "component_id"), n), "by-fingerprint")
    return _dealt(fps.join(lone, "fp").select("doc_id", "fp", "component_id", *carry), n)


def hex16(column: str):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))

