"""Substring dedup over a log-structured fingerprint index.

The unit is a window of 13 words. The index doesn't hold all windows: of every window it holds
the least hash of the 7-word windows inside it, about one for every four words. Equal windows
have equal least hashes, so a window that occurs in two documents always shows up as a shared
fingerprint. Each batch of documents becomes an immutable run, hash-bucketed and sorted by
fingerprint, beside its texts. It is merge-joined with the runs before it, bucket by bucket,
without a shuffle or a sort, and its repeats are removed; when there are over FANOUT runs they are
compacted into one, again bucket by bucket.

Shared fingerprints only nominate windows. Nominated windows are matched by hashes of all their
words, in stretches first, runs of matches become claims "these words stand there too", and every
claim is verified, in pieces, against the words of the earlier document. If a claim is false (two
hashes collided), the windows it covers are matched again by the words themselves.
"""

from __future__ import annotations

import functools
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.llm.common import ASCII_SPACE, release, shared_dir, staged

WINDOW = 13
GRAM = 7
#: Runs that an index holds before they are compacted.
FANOUT = 4
#: Words of a source's text that a piece of a claim is verified against.
BLOCK = 64
#: Bytes of text hashed at once, or one text that is longer.
SLICE = 400_000

KEY = ("doc_id", "copy")


def _seq():
    """The batch that a text came with: the upper half of its ``copy``."""
    return F.shiftright("copy", 32)


_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


@functools.lru_cache(maxsize=4)
def _powers_to(base: int, bits: int):
    import numpy as np

    made = np.full(1 << bits, base, "u8")
    made[0] = 1
    return np.cumprod(made)


def _powers(base: int, n: int):
    """base ** 0, 1, ... n - 1 modulo 2 ** 64."""
    return _powers_to(base, max(n.bit_length(), 16))[:n]


def _mixed(total):
    import numpy as np

    for _ in range(2):
        total ^= total >> np.uint64(32)
        total *= np.uint64(0xD6E8FEB86659FD93)
    total ^= total >> np.uint64(32)
    return total


class Hasher:
    """Hashes of words and of windows of words; ``bits`` below 64 weakens them, for tests."""

    def __init__(self, bits: int = 64):
        self.bits = bits

    def texts(self, texts: list[bytes]):
        """Word hashes of all texts in a row, the start of each text, and, for each place at which
        a window could begin, its text and whether the window ends in that text too."""
        import numpy as np

        blanks = np.zeros(256, bool)
        blanks[list(ASCII_SPACE.encode())] = True
        raw = np.frombuffer(b" ".join([*texts, b""]), "u1")
        blank = blanks[raw]
        begins = ~blank
        begins[1:] &= blank[:-1]
        start = np.flatnonzero(begins)
        if len(start):
            place = np.arange(start[0], len(raw)) - np.repeat(start, np.diff(np.append(start, len(raw))))
            value = _powers(_MULTIPLIER, int(place.max()) + 1)[place] * (raw[start[0] :] + np.uint64(1))
            value[blank[start[0] :]] = 0
            hashes = _mixed(np.add.reduceat(value, start - start[0]))
        else:
            hashes = np.zeros(0, "u8")
        sizes = np.fromiter(map(len, texts), "i8", len(texts)) + 1
        starts = np.searchsorted(start, np.cumsum(sizes) - sizes)
        owner = np.repeat(np.arange(len(texts)), np.diff(np.append(starts, len(start))))
        n = max(len(hashes) - WINDOW + 1, 0)
        return hashes, starts, owner[:n], owner[:n] == owner[WINDOW - 1 :]

    def spans(self, hashes, first, n):
        """One hash for each span of ``n`` hashes from ``first``, whatever stands around it."""
        import numpy as np

        total = np.zeros(len(hashes) + 1, "u8")
        np.cumsum(hashes * _powers(_MULTIPLIER, len(hashes)), out=total[1:])
        made = (total[first + n] - total[first]) * _powers(_INVERSE, len(hashes) + 1)[first]
        return _mixed(made) >> np.uint64(64 - self.bits)

    def windows(self, hashes, size: int):
        """One hash for each window of ``size`` words."""
        import numpy as np

        return self.spans(hashes, np.arange(max(len(hashes) - size + 1, 0)), size)

    def stretches(self, texts: list[bytes]):
        """Stretches of windows with one least hash of the GRAM-word windows inside them: that hash,
        text, first place among all words and number of windows; then the window hashes and the
        start of each text."""
        import numpy as np

        hashes, starts, owner, inside = self.texts(texts)
        least = self.windows(hashes, GRAM)
        reach, span = 1, WINDOW - GRAM + 1
        while reach < span:
            step = min(reach, span - reach)
            least = np.minimum(least[: len(least) - step], least[step:])
            reach += step
        least = least[: len(owner)]
        place = np.flatnonzero(inside)
        least, own = least[place], owner[place]
        edge = np.ones(len(place), bool)
        edge[1:] = (np.diff(place) != 1) | (own[1:] != own[:-1]) | (least[1:] != least[:-1])
        edge = np.flatnonzero(edge)
        n = np.diff(np.append(edge, len(place)))
        return least[edge], own[edge], place[edge], n, hashes, starts


def _batch(columns, names):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(columns, names=names)


def _slices(batches):
    """Parts of the batches whose texts together are not over SLICE bytes, and these texts."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        begin, size, texts = 0, 0, []
        for k, z in enumerate(batch.column("z").to_pylist()):
            text = unpack.decompress(z)
            if texts and size + len(text) > SLICE:
                yield batch.slice(begin, len(texts)), texts
                begin, size, texts = k, 0, []
            texts.append(text)
            size += len(text)
        if texts:
            yield batch.slice(begin, len(texts)), texts


def _numbers(column):
    return column.to_numpy(zero_copy_only=False)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this run wrote to the shared folder."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _copies(docs: DataFrame, seq: int) -> DataFrame:
    """doc_id, copy, text: rows of one doc_id with different texts get different copies."""
    base = F.lit(seq << 32).cast("long")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if again.isEmpty():
        return docs.select("doc_id", base.alias("copy"), "text")
    twice = docs.join(again.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.sha2("text", 256).alias("h"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("h"))
    numbers = twice.distinct().withColumn("number", number).withColumnsRenamed({"doc_id": "d", "h": "hh"})
    same = F.col("d").eqNullSafe(F.col("doc_id")) & F.col("hh").eqNullSafe(F.sha2("text", 256))
    return docs.join(numbers, same, "left").select("doc_id", (base + F.coalesce("number", F.lit(0))).alias("copy"), "text")


def _packed(batches):
    """Texts compressed: what is shuffled, kept and read again."""
    import pyarrow as pa
    import zstandard

    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [pack.compress((x or "").encode()) for x in batch.column("text").to_pylist()]
        yield _batch([batch.column("doc_id"), batch.column("copy"), pa.array(texts, pa.binary())], ["doc_id", "copy", "z"])


def _stretched(bits: int):
    """Rows (fp, h, doc_id, copy, pos, n): n windows from word pos on that have the least hash fp, and
    a hash of all their words. Stretches begin and end by their own words, so equal passages have
    equal stretches but at their ends."""

    def run(batches):
        import pyarrow as pa

        hasher = Hasher(bits)
        for batch, texts in _slices(batches):
            least, owner, place, n, hashes, starts = hasher.stretches(texts)
            h = hasher.spans(hasher.windows(hashes, WINDOW), place, n)
            doc_ids, copies = _numbers(batch.column("doc_id"))[owner], _numbers(batch.column("copy"))[owner]
            columns = (least.view("i8"), h.view("i8"), doc_ids, copies, (place - starts[owner]).astype("i4"), n.astype("i4"))
            yield _batch([pa.array(x) for x in columns], PRINT)

    return run


def _windowed(bits: int):
    """Rows (h, doc_id, copy, pos, n = 1): every window of the stretches that ``at`` lists."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hasher = Hasher(bits)
        for batch, texts in _slices(batches):
            doc_ids, copies = _numbers(batch.column("doc_id")), _numbers(batch.column("copy"))
            marks = batch.column("at")
            owner = np.repeat(np.arange(len(marks)), np.diff(_numbers(marks.offsets)))
            copy, pos, n = (_numbers(marks.flatten().field(x)) for x in ("copy", "pos", "n"))
            mine = copy == copies[owner]
            hashes, starts, *_ = hasher.texts(texts)
            owner, n = owner[mine], n[mine].astype("i8")
            first = starts[owner] + pos[mine]
            place = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            owner, h = np.repeat(owner, n), hasher.spans(hashes, place, WINDOW)
            columns = (h.view("i8"), doc_ids[owner], copies[owner], (place - starts[owner]).astype("i4"), np.ones(len(place), "i4"))
            yield _batch([pa.array(x) for x in columns], ["h", "doc_id", "copy", "pos", "n"])

    return run


PRINT = ["fp", "h", "doc_id", "copy", "pos", "n"]
PRINT_ROWS = "fp long, h long, doc_id long, copy long, pos int, n int"
ROWS = "h long, doc_id long, copy long, pos int, n int"
PIECE = ("sdoc", "scopy", "block", "at", "n", "words")
PIECE_ROWS = "sdoc long, scopy long, block int, at int, n int, words string"
CLAIM = "sdoc: bigint, scopy: bigint, spos: int, len: int, words: string"
GONE = "array<struct<copy: bigint, pos: int, n: int, sdoc: bigint, scopy: bigint, spos: int>>"


def _finish(batches):
    """Remove covered words; consecutive matches with one source become claims.

    ``gone`` has stretches of matched windows and their sources, ``bad`` the spans whose claims
    proved false, and ``extra`` the matches that replace them.
    """
    import hashlib

    import numpy as np
    import pyarrow as pa

    claim = pa.struct(
        [("sdoc", pa.int64()), ("scopy", pa.int64()), ("spos", pa.int32()), ("len", pa.int32()), ("words", pa.string()), ("pos", pa.int32())]
    )

    def opened(column):
        """Where the list of each row begins in the fields of all lists, and these fields."""
        offsets, flat = _numbers(column.offsets), column.flatten()
        return (offsets - offsets[0]).tolist(), [_numbers(flat.field(x)).astype("i8") for x in ("copy", "pos", "n", "sdoc", "scopy", "spos")]

    def stretched(lists, k, copy):
        """pos, sdoc, scopy, spos of every single window of row k, which is this copy."""
        offsets, fields = lists
        copies, *rest = (x[offsets[k] : offsets[k + 1]] for x in fields)
        mine = copies == copy
        pos, n, sdoc, scopy, spos = (x[mine] for x in rest)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return [np.repeat(pos, n) + step, np.repeat(sdoc, n), np.repeat(scopy, n), np.repeat(spos, n) + step]

    for batch, texts in _slices(batches):
        out: list[list] = [[], [], [], []]
        gone, extra = opened(batch.column("gone")), opened(batch.column("extra"))
        any_extra = extra[0][-1] > 0
        bad = batch.column("bad").to_pylist()
        for k, (copy, text) in enumerate(zip(batch.column("copy").to_pylist(), texts, strict=True)):
            words = text.split()
            n, removed, kept, claims = len(words), 0, b" ".join(words), []
            if gone[0][k] < gone[0][k + 1] or extra[0][k] < extra[0][k + 1]:
                found = stretched(gone, k, copy)
                for span in bad[k] or []:
                    if span["copy"] != copy:
                        continue
                    ok = (found[0] < span["pos"]) | (found[0] > span["pos"] + span["len"] - WINDOW)
                    found = [x[ok] for x in found]
                if any_extra:
                    found = [np.concatenate(x) for x in zip(found, stretched(extra, k, copy), strict=True)]
                _, once = np.unique(found[0], return_index=True)
                pos, sdoc, scopy, spos = (x[once] for x in found)
                ends = np.cumsum(np.fromiter(map(len, words), "i8", n) + 1)  # of each word and its blank
                begins = np.append(0, ends)
                same = (np.diff(pos) == 1) & (np.diff(sdoc) == 0) & (np.diff(scopy) == 0) & (np.diff(spos) == 1)
                first = np.flatnonzero(np.concatenate(([True], ~same)))[: len(pos)]
                length = np.diff(np.append(first, len(pos))) - 1 + WINDOW
                here = pos[first]
                for s, m, c, *src in zip(here.tolist(), length.tolist(), *(x[first].tolist() for x in (sdoc, scopy, spos)), strict=True):
                    claims.append((c, *src, m, kept[begins[s] : begins[s + m] - 1].decode(), s))
                edges = np.zeros(n + 1, "i8")
                np.add.at(edges, here, 1)
                np.add.at(edges, here + length, -1)
                gaps = np.diff(np.concatenate(([1], np.cumsum(edges)[:n] > 0, [1])).astype("i1"))  # of words that stay
                spans = list(zip(np.flatnonzero(gaps < 0).tolist(), np.flatnonzero(gaps > 0).tolist(), strict=True))
                removed = n - sum(e - s for s, e in spans)
                kept = b" ".join([kept[begins[s] : begins[e] - 1] for s, e in spans])
            for column, value in zip(out, (n, removed, hashlib.sha256(kept).hexdigest(), claims), strict=True):
                column.append(value)
        own = list(zip(*(x for claims in out[3] for x in claims), strict=True)) or [[]] * len(claim)
        listed = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(own, claim, strict=True)], fields=list(claim))
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in out[3]]))).astype("i4")
        kinds = (pa.int64(), pa.int64(), pa.string())
        made = [pa.array(x, k) for x, k in zip(out, kinds, strict=False)]
        yield _batch(
            [batch.column("doc_id"), batch.column("copy"), *made, pa.ListArray.from_arrays(offsets, listed)],
            ["doc_id", "copy", "n_words", "n_removed", "kept_sha256", "claims"],
        )


def _pieces(batches):
    """Claims cut where blocks of BLOCK words of the source begin: rows (sdoc, scopy, block, at, n,
    words), and the claim's own columns in ``keys``, if it has them."""
    import pyarrow as pa

    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    for batch in batches:
        keys = [c for c in ("doc_id", "copy", "pos") if c in batch.schema.names]
        out: list[list] = [[], [], [], [], [], []]
        owner = []
        rows = zip(*(batch.column(c).to_pylist() for c in ("sdoc", "scopy", "spos", "len", "words")), strict=True)
        for k, (sdoc, scopy, spos, length, text) in enumerate(rows):
            words = text.split(" ")
            for block in range(spos // BLOCK, (spos + length - 1) // BLOCK + 1):
                lo, hi = max(spos, block * BLOCK), min(spos + length, (block + 1) * BLOCK)
                piece = " ".join(words[lo - spos : hi - spos])
                for column, value in zip(out, (sdoc, scopy, block, lo - block * BLOCK, hi - lo, piece), strict=True):
                    column.append(value)
                owner.append(k)
        own = [batch.column(c).take(pa.array(owner, pa.int64())) for c in keys]
        yield _batch([*(pa.array(x, k) for x, k in zip(out, kinds, strict=True)), *own], [*PIECE, *keys])


def _blocks(batches):
    """The words of each block of BLOCK words of a text."""
    import pyarrow as pa

    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string())
    for batch, texts in _slices(batches):
        out: list[list] = [[], [], [], []]
        for doc_id, copy, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "copy")), texts, strict=True):
            words = text.split()
            for at in range(0, len(words), BLOCK):
                piece = b" ".join(words[at : at + BLOCK]).decode()
                for column, value in zip(out, (doc_id, copy, at // BLOCK, piece), strict=True):
                    column.append(value)
        yield _batch([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["sdoc", "scopy", "block", "source"])


def false_pieces(claims: DataFrame, *texts: DataFrame) -> DataFrame:
    """The pieces of claims (sdoc, scopy, spos, len, words) that the words of the source, one of
    ``texts`` (doc_id, copy, z), don't bear out.

    Claims on one source can be as many as its later copies, so they are never put together by
    source: a row is a piece of BLOCK words at most, and meets only its block of the source.
    Pieces of true claims are few for a block, however many claims there are.
    """
    sources = claims.select(F.col("sdoc").alias("doc_id")).distinct()
    known = [
        x.select("doc_id", F.col("copy").cast("long").alias("copy"), "z")
        .join(sources.hint("merge"), "doc_id", "left_semi")
        .mapInArrow(_blocks, "sdoc long, scopy long, block int, source string")
        for x in texts
    ]
    pieces = claims.select("sdoc", "scopy", "spos", "len", "words").mapInArrow(_pieces, PIECE_ROWS).distinct()
    there = F.array_join(F.slice(F.split("source", " "), F.col("at") + 1, F.col("n")), " ")
    same = F.coalesce((F.col("source") == F.col("words")) | (there == F.col("words")), F.lit(False))
    known = reduce(DataFrame.unionByName, known)
    return pieces.join(known, ["sdoc", "scopy", "block"], "left").where(~same).select(*PIECE)


def _hashes_of(bits: int):
    """The window hashes of the claims."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hasher = Hasher(bits)
        for batch in batches:
            made = [np.zeros(0, "u8")]
            for words in batch.column("words").to_pylist():
                made.append(hasher.windows(hasher.texts([words.encode()])[0], WINDOW))
            yield _batch([pa.array(np.unique(np.concatenate(made)).view("i8"))], ["h"])

    return run


def _with_words(batches):
    """The words of single windows, for matching without a hash."""
    import pyarrow as pa

    names = ["h", "doc_id", "copy", "pos", "n"]
    for batch, texts in _slices(batches):
        words = [b" ".join(text.split()[pos : pos + WINDOW]).decode() for text, pos in zip(texts, batch.column("pos").to_pylist(), strict=True)]
        yield _batch([*(batch.column(c) for c in names), pa.array(words, pa.string())], [*names, "words"])


def _firsts(rows: DataFrame, by: list[str]) -> DataFrame:
    """The first place, ``src``, of each ``by``: earlier batches first, then the least doc_id. Tasks add
    up their own rows before the shuffle, so one that all documents share costs a row from each."""
    place = F.struct(_seq().alias("seq"), "doc_id", "copy", "pos")
    return rows.groupBy(*by).agg(F.min(place).alias("src"), F.max(place).alias("last"))


def _repeats(seq: int):
    """Whether a row of batch ``seq`` stands in an earlier document too."""
    before = (F.col("src.seq") < seq) | (F.col("src.doc_id") < F.col("doc_id"))
    return (_seq() == seq) & before & (F.col("src.doc_id") != F.col("doc_id"))


def _later(rows: DataFrame, by: list[str], seq: int) -> DataFrame:
    """Rows of batch ``seq`` that also stand in an earlier document: doc_id, gone.

    The first places are written before the join: a join of two plain shuffles can be split where
    a row is very common, a join with an aggregation beside it can't.
    """
    several = F.col("last.seq") == seq, F.col("src.doc_id") != F.col("last.doc_id")
    first = staged(_firsts(rows, by).where(several[0] & several[1]).drop("last"), "firsts")
    return rows.where(_seq() == seq).join(first, by).where(_repeats(seq)).select("doc_id", _gone())


def _gone():
    src = (F.col("src.doc_id").alias("sdoc"), F.col("src.copy").alias("scopy"), F.col("src.pos").alias("spos"))
    return F.struct("copy", "pos", "n", *src).alias("gone")


def _lists(rows: DataFrame, column: str, name: str) -> DataFrame:
    """One list for each doc_id: a document's own matches, as many as its words at most. The texts
    are bucketed by doc_id alone, so this is what they are joined by, and a list names its copies."""
    return rows.groupBy("doc_id").agg(F.collect_list(column).alias(name))


@contextmanager
def _settings(spark: SparkSession, **values: str):
    """Session settings while a batch is added: sorted bucket files are merge-joined as they are."""
    names = {k: f"spark.sql.{v}" for k, v in _SETTINGS.items()}
    values = {"sorted_buckets": "true", "sorted_aggregates": "true", "union_partitions": "false"} | values
    before = {names[k]: spark.conf.get(names[k]) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(names[k], v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


_SETTINGS = {
    "sorted_buckets": "legacy.bucketedTableScan.outputOrdering",
    "sorted_aggregates": "execution.replaceHashWithSortAgg",
    "all_keys": "requireAllClusterKeysForCoPartition",
    # A union of bucketed scans says that it is bucketed too, but its partitions are those of the scans
    # one after the other: an aggregation above it would be wrong.
    "union_partitions": "unionOutputPartitioning",
    # Buckets that a task may write at once; at none, the default, it sorts its rows by bucket first.
    "open_files": "maxConcurrentOutputFileWriters",
}
#: Columns that a run is bucketed by (the first) and sorted by, and the others.
COLUMNS = {"prints": PRINT_ROWS, "texts": "doc_id long, copy long, z binary"}
KINDS = {"prints": (("fp", "doc_id", "copy", "pos"), ("h", "n")), "texts": (("doc_id", "copy"), ("z",))}


class SubstringIndex:
    """A standing index in the shared folder: runs of stretches (fp, h, doc_id, copy, pos, n) bucketed
    and sorted by fp, each beside the texts (doc_id, copy, z) that it was made of, bucketed and
    sorted by doc_id.

    ``add`` appends a batch and returns its rows with what is left of them. Runs never change;
    compaction writes new ones, then drops those they replace. A manifest, written last, names the
    runs, so that ``open`` finds the index as it was after the last batch that was added whole.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT, bits: int = 64):
        self.spark, self.fanout, self.bits = spark, fanout, bits
        self.path = path or shared_dir(spark, "substring")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: dict[str, list[str]] = {kind: [] for kind in KINDS}
        self.seq = self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SubstringIndex:
        """The index at ``path`` as its last manifest has it, in this session or another."""
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest-*/_SUCCESS")
        found = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(fs_path)
        last = max(x.getPath().getParent().toString() for x in found)
        index = cls(spark, path)
        index.version = int(last.rpartition("-")[2])
        for r in sorted(spark.read.parquet(last).collect(), key=lambda r: r.place):
            index.fanout, index.bits, index.buckets, index.seq = r.fanout, r.bits, r.buckets, r.seq
            if r.kind:
                index.runs[r.kind].append(r.name)
                index._declare(r.kind, r.name)
        return index

    def _declare(self, kind: str, name: str) -> None:
        """A table over the files of a run."""
        keys = KINDS[kind][0]
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({COLUMNS[kind]}) USING parquet CLUSTERED BY ({keys[0]}) "
            f"SORTED BY ({', '.join(keys)}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'"
        )

    def _commit(self) -> None:
        runs = [(k, kind, name) for kind, names in self.runs.items() for k, name in enumerate(names)] or [(0, None, None)]
        rows = [(*run, self.buckets, self.fanout, self.bits, self.seq) for run in runs]
        schema = "place int, kind string, name string, buckets int, fanout int, bits int, seq long"
        self.version += 1
        self.spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{self.path}/manifest-{self.version:010d}")

    def _write(self, rows: DataFrame, kind: str) -> str:
        """A new run of ``rows``, of which a task has whole buckets, sorted.

        With ``sortBy`` Spark would sort once more, by the bucket first, which is one value in all
        rows of a task, so that every two rows were compared column by column. The files are
        written as the rows come, and the table that says so is made over them.
        """
        name, keys = f"{kind}_{uuid.uuid4().hex}", KINDS[kind][0]
        writer = rows.write.bucketBy(self.buckets, keys[0]).option("path", f"{self.path}/{name}")
        with _settings(self.spark, open_files=str(self.buckets)):
            writer.option("compression", "zstd").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        self._declare(kind, name)
        return name

    def _run(self, rows: DataFrame, kind: str) -> str:
        """A new run of ``rows`` in any order."""
        keys = KINDS[kind][0]
        return self._write(rows.repartition(self.buckets, keys[0]).sortWithinPartitions(*keys), kind)

    def compact(self) -> None:
        """Merge the runs into one, two at a time and bucket by bucket, dropping what each merge replaces."""
        for kind, (keys, values) in KINDS.items():
            while len(self.runs[kind]) > 1:
                *rest, older, newer = self.runs[kind]
                with _settings(self.spark, all_keys="false"):
                    # No key is in two runs, so a full outer merge join is the runs' rows in one order,
                    # and they are written as they come.
                    new = self.spark.table(newer).withColumnsRenamed({x: f"new_{x}" for x in values}).hint("merge")
                    rows = self.spark.table(older).join(new, list(keys), "full_outer")
                    made = self._write(rows.select(*keys, *[F.coalesce(x, f"new_{x}").alias(x) for x in values]), kind)
                self.runs[kind] = [*rest, made]
                self._commit()
                self._drop(older, newer)

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, f"{self.path}/{name}")

    def close(self) -> None:
        """Drop the index."""
        for names in self.runs.values():
            self._drop(*names)
            names.clear()
        remove(self.spark, self.path)

    def add(self, docs: DataFrame) -> DataFrame:
        """doc_id, copy, n_words, n_removed, kept_sha256 of the rows of ``docs``.

        A word goes if a window of 13 words that covers it also starts in a document of an earlier
        batch, or in one of this batch with a smaller doc_id. Rows of one doc_id are no sources for
        each other. A row with a null doc_id keeps all its words and is not indexed. A null or
        empty text has no words. Columns beside doc_id and text are not read.
        """
        with _settings(self.spark):
            return self._add(docs)

    def _add(self, docs: DataFrame) -> DataFrame:
        spark, bits, seq = self.spark, self.bits, self.seq
        work = f"{self.path}/work-{seq}"
        # Filters don't pass below the compression, so they stand before it.
        named, unnamed = (_copies(docs, seq).where(x).mapInArrow(_packed, "doc_id long, copy long, z binary") for x in ("doc_id is not null", "doc_id is null"))
        texts_name = self._run(named, "texts")
        texts = spark.table(texts_name)
        made = texts.mapInArrow(_stretched(bits), PRINT_ROWS)
        name = self._run(made, "prints")
        new, before = spark.table(name), [spark.table(x) for x in self.runs["texts"]]
        olds = [spark.table(x) for x in self.runs["prints"]]
        shared, known = new.groupBy("fp").agg((F.min("doc_id") < F.max("doc_id")).alias("shared")), F.col("shared")
        for k, old in enumerate(olds):
            shared = shared.join(old.select("fp").distinct().withColumn(f"old{k}", F.lit(True)).hint("merge"), "fp", "left")
            known = known | F.col(f"old{k}").isNotNull()
        hits = [new.join(shared.where(known).select("fp").hint("merge"), "fp", "left_semi")]
        hits += [old.join(new.select("fp").hint("merge"), "fp", "left_semi") for old in olds]
        stretches = staged(reduce(DataFrame.unionByName, hits), "stretches", f"{work}/stretches")
        release(spark)

        # Stretches first: one that an earlier document has too is settled as a whole. The others are
        # looked at window by window, if another stretch has the same fingerprint.
        firsts = staged(_firsts(stretches, ["h", "fp"]).drop("last"), "firsts", f"{work}/firsts")
        placed = stretches.join(firsts.drop("fp"), "h").select(
            "fp", "doc_id", "copy", _repeats(seq).alias("repeats"), ((_seq() == seq) | (F.col("src.copy") == F.col("copy"))).alias("stays"), _gone()
        )
        placed = staged(placed, "placed", f"{work}/placed")
        remove(spark, f"{work}/stretches")
        whole = placed.where("repeats").select("doc_id", "gone")
        mixed = firsts.groupBy("fp").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi")
        mixed = staged(mixed.select("fp"), "mixed", f"{work}/mixed")
        at = F.struct("gone.copy", "gone.pos", "gone.n").alias("at")
        left = placed.where("stays and not repeats").select("fp", "doc_id", at).join(mixed.hint("merge"), "fp", "left_semi")
        left = _lists(left, "at", "at")
        rows = [x.join(left.hint("merge"), "doc_id").mapInArrow(_windowed(bits), ROWS) for x in (texts, *before)]
        single = staged(reduce(DataFrame.unionByName, rows), "single", f"{work}/single")
        matches = whole.unionByName(_later(single, ["h"], seq))
        matches = staged(_lists(matches, "gone", "gone"), "gone", f"{work}/gone")
        remove(spark, f"{work}/single")
        release(spark)

        def finished(gone: DataFrame, bad: DataFrame | None, extra: DataFrame | None, label: str) -> DataFrame:
            rows = texts.join(gone.hint("merge"), "doc_id", "left")
            rows = rows.join(bad, "doc_id") if bad else rows.withColumn("bad", F.lit(None).cast("array<struct<copy: bigint, pos: int, len: int>>"))
            rows = rows.join(extra, "doc_id", "left") if extra else rows.withColumn("extra", F.lit(None).cast(GONE))
            return staged(_finished(rows), label, f"{work}/{label}")

        result = finished(matches, None, None, "by-hash")
        made = result.select("doc_id", "copy", F.explode("claims").alias("c")).select(*KEY, "c.*")
        false = staged(false_pieces(made, texts, *before), "false", f"{work}/false")
        if not false.isEmpty():
            cut = made.mapInArrow(_pieces, f"{PIECE_ROWS}, doc_id long, copy long, pos int")
            bad = made.join(cut.join(false, list(PIECE), "left_semi").select(*KEY, "pos").distinct(), [*KEY, "pos"])
            bad = staged(bad, "bad", f"{work}/bad")
            spans = _lists(bad.select("doc_id", F.struct("copy", "pos", "len").alias("bad")), "bad", "bad")
            hashes = bad.select("words").distinct().mapInArrow(_hashes_of(bits), "h long").distinct()
            every = _lists(placed.select("doc_id", at), "at", "at")
            all_texts = reduce(DataFrame.unionByName, [texts, *before])
            doubtful = all_texts.join(every, "doc_id").mapInArrow(_windowed(bits), ROWS).join(hashes, "h", "left_semi")
            worded = doubtful.join(all_texts, list(KEY)).mapInArrow(_with_words, f"{ROWS}, words string")
            extra = _lists(_later(worded, ["h", "words"], seq).withColumnRenamed("gone", "extra"), "extra", "extra")
            again = finished(matches, staged(spans, "spans", f"{work}/spans"), extra, "by-words")
            result = result.join(again.select("doc_id"), "doc_id", "left_anti").unionByName(again)  # both are written
        unnamed = unnamed.withColumns({"gone": F.lit(None).cast(GONE), "extra": F.lit(None).cast(GONE)})
        unnamed = _finished(unnamed.withColumn("bad", F.lit(None).cast("array<struct<copy: bigint, pos: int, len: int>>")))
        result = staged(result.unionByName(unnamed).drop("claims"), "result")
        self.runs["prints"].append(name)
        self.runs["texts"].append(texts_name)
        self.seq += 1
        self._commit()
        remove(spark, work)
        release(spark)
        if len(self.runs["prints"]) > self.fanout:
            self.compact()
        return result


def _finished(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "copy", "z", "gone", "bad", "extra").mapInArrow(
        _finish, f"doc_id long, copy long, n_words long, n_removed long, kept_sha256 string, claims array<struct<{CLAIM}, pos: int>>"
    )


def deduplicated(docs: DataFrame, batches: int = 2, fanout: int = 1, bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, one row for each row of ``docs``.

    A word goes if a window of 13 words that covers it also starts in a document of smaller
    doc_id, judged on the input. Documents join an index, which is dropped in the end, in ``batches``
    ranges of doc_id; it is compacted on the way. For nulls, empty texts and repeated rows see ``SubstringIndex.add``.
    """
    spark = docs.sparkSession
    index = SubstringIndex(spark, fanout=fanout, bits=bits)
    edges = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    edges = sorted(set(edges))
    d, made = F.col("doc_id"), []
    try:
        for lo, hi in zip([None, *edges], [*edges, None], strict=True):
            own = (F.lit(True) if lo is None else d > lo) & (F.lit(True) if hi is None else d <= hi)
            made.append(index.add(docs.where(own if lo is not None else own | d.isNull())))
    finally:
        index.close()
    return reduce(DataFrame.unionByName, made).select("doc_id", "n_words", "n_removed", "kept_sha256")
