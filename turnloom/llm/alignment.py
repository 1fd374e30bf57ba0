"""Alignment of two tokenizers' tokens, each distinct text once.

Texts are shuffled by their full content, so that copies meet and a text is encoded once, with the
number of its rows as its weight. Where tokens of both encodings end at one byte, a group ends;
between two neighbouring ends lies a part of exactly one token of either side, which is a link.

Counts of linked id pairs are over the corpus. Texts are worked on in blocks (an Arrow batch). A
block keeps the list of its distinct pairs, once, and for each text places in that list; only the
lists are joined with the corpus-wide counts and come back to their blocks. So what is shuffled is
a row for each pair of a block, not one for each link, and nothing needs to be broadcast.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.bpe import encode_text, encoding
from turnloom.llm.common import staged

#: Bytes of an Arrow batch, and so of a block's texts, or one text that is longer.
BLOCK_BYTES = 6 << 20

MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_TEXT = "struct<key: binary, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string>"
_BLOCK = f"texts array<{_TEXT}>, ends array<int>, slots array<int>, times array<int>, pairs array<bigint>, weights array<bigint>"
_RESULT = "key binary, " + ", ".join(f"{x} long" for x in MEASURES) + ", groups_sha256 string"


class Side:
    """The bytes of each id of a vocabulary, and its decimal digits."""

    def __init__(self, pieces: list):
        import numpy as np

        self.pieces = pieces
        self.sizes = np.array([len(x) for x in pieces], "i8")
        self.width = len(str(max(len(pieces) - 1, 0)))
        names = [str(i) for i in range(len(pieces))]
        self.digits = np.frombuffer("".join(x.rjust(self.width, " ") for x in names).encode(), "u1").reshape(-1, self.width)

    def spell(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


class Encoders:
    """Side A: byte-level BPE by a rank file. Side B: a sentencepiece model, which puts a blank
    before a text itself."""

    def __init__(self, rank_file: str, pattern: str, piece_file: str):
        import sentencepiece

        self.a = encoding(rank_file, pattern)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        self.side_a = Side([self.a.decode_single_token_bytes(i) for i in range(self.a.n_vocab)])
        pieces = map(self.b.id_to_piece, range(self.b.get_piece_size()))
        spelt = (bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces))
        self.side_b = Side(list(spelt))

    def __call__(self, text: str | None) -> tuple:
        """Ids of both sides, none at all where either doesn't spell a blank and the text."""
        if not text:
            return [], []
        own = " " + text
        raw = own.encode()
        b = self.b.encode(text, num_threads=1)
        if self.side_b.spell(b) != raw:
            return [], []
        a = encode_text(self.a, own)
        return (a, b) if self.side_a.spell(a) == raw else ([], [])


@functools.lru_cache(maxsize=2)
def encoders(rank_file: str, pattern: str, piece_file: str) -> Encoders:
    """Kept for the life of a Python worker."""
    return Encoders(rank_file, pattern, piece_file)


class Batch:
    """Tokens of some texts in a row, their groups and links."""

    def __init__(self, enc: Encoders, texts: list):
        import numpy as np

        a, b, n_a, n_b = [], [], [], []
        for text in texts:
            own_a, own_b = enc(text)
            a.append(np.array(own_a, "i4"))
            b.append(np.array(own_b, "i4"))
            n_a.append(len(own_a))
            n_b.append(len(own_b))
        self.enc, self.n = enc, len(texts)
        self.n_a, self.n_b = np.array(n_a, "i8"), np.array(n_b, "i8")
        self.a, self.b = (np.concatenate([np.zeros(0, "i4"), *x]) for x in (a, b))
        ends_a, ends_b = np.cumsum(enc.side_a.sizes[self.a]), np.cumsum(enc.side_b.sizes[self.b])
        size = int(ends_a[-1]) if len(ends_a) else 0
        is_a, is_b = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        is_a[ends_a] = is_b[ends_b] = True
        ends = np.flatnonzero(is_a | is_b)
        at_a, at_b = is_a[ends], is_b[ends]
        cut = at_a & at_b
        before = lambda x: np.cumsum(x) - x
        self.link_a, self.link_b = before(at_a), before(at_b)
        group = before(cut)
        self.group_a, self.group_b = group[at_a], group[at_b]
        owner_a = np.repeat(np.arange(self.n), self.n_a)
        self.link_text = owner_a[self.link_a]
        self.n_links = np.bincount(self.link_text, minlength=self.n)
        self.n_groups = np.bincount(self.link_text[cut], minlength=self.n)

    def spelt_groups(self) -> list:
        """Per text, its groups as bytes ``a1,a2|b1;a3|b2,b3``."""
        import numpy as np

        sides, groups = (self.enc.side_a, self.enc.side_b), (self.group_a, self.group_b)
        n, width = len(self.a) + len(self.b), max(x.width for x in sides)
        rows = np.full((n, width + 1), ord(" "), "u1")
        n_groups = int(self.group_a[-1]) + 1 if len(self.a) else 0
        upto = [np.concatenate(([0], np.cumsum(np.bincount(g, minlength=n_groups)))) for g in groups]
        places = np.arange(len(self.a)) + upto[1][self.group_a], np.arange(len(self.b)) + upto[0][self.group_b + 1]
        for side, ids, group, place, mark in zip(sides, (self.a, self.b), groups, places, b"|;", strict=True):
            rows[place, width - side.width : width] = side.digits[ids]
            last = np.ones(len(ids), bool)
            last[:-1] = group[1:] != group[:-1]
            rows[place, width] = np.where(last, mark, ord(","))
        filled = rows != ord(" ")
        flat = rows[filled].tobytes()
        ends = np.concatenate(([0], np.cumsum(filled.sum(axis=1))))[np.cumsum(self.n_a + self.n_b)]
        starts = np.concatenate(([0], ends[:-1]))
        return [flat[lo : hi - 1] if hi > lo else b"" for lo, hi in zip(starts, ends, strict=True)]

    def pair_lists(self):
        """Distinct id pairs in ascending order, and per text its places in that list with how
        often the text links each: (pairs, ends of the texts, places, times)."""
        import numpy as np

        wide = len(self.enc.side_b.sizes)
        every = len(self.enc.side_a.sizes) * wide
        code = self.a[self.link_a].astype("i8") * wide + self.b[self.link_b]
        keys, times = np.unique(self.link_text * every + code, return_counts=True)
        pairs, slots = np.unique(keys % every, return_inverse=True)
        return pairs, np.searchsorted(keys, np.arange(1, self.n + 1) * every), slots, times


def _blocks(*files):
    def run(batches):
        import hashlib

        import numpy as np

        enc = encoders(*files)
        for batch in batches:
            if not batch.num_rows:
                continue
            made = Batch(enc, batch.column("text").to_pylist())
            pairs, ends, slots, times = made.pair_lists()
            owner = np.repeat(np.arange(made.n), np.diff(np.append(0, ends)))
            weights = np.zeros(len(pairs), "i8")
            np.add.at(weights, slots, np.asarray(batch.column("copies"), "i8")[owner])
            digests = [hashlib.sha256(x).hexdigest() if x else "" for x in made.spelt_groups()]
            texts = pa.StructArray.from_arrays(
                [batch.column("key"), *map(pa.array, (made.n_a, made.n_b, made.n_groups, made.n_links)), pa.array(digests, pa.string())],
                names=["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"],
            )
            one = lambda x, t: pa.ListArray.from_arrays([0, len(x)], pa.array(x, t))
            row = [pa.ListArray.from_arrays([0, made.n], texts), one(ends, "int32"), one(slots, "int32"), one(times, "int32")]
            row += [one(pairs, "int64"), one(weights, "int64")]
            yield pa.RecordBatch.from_arrays(row, names=["texts", "ends", "slots", "times", "pairs", "weights"])

    return run


def _measured(left: pa.Table, right: pa.Table) -> pa.Table:
    """The texts of one block with the counts of their pairs."""
    import numpy as np

    order = np.argsort(np.asarray(right["pair"]))
    counts, best = np.asarray(right["n"])[order], np.asarray(right["best"])[order].astype("i8")
    row = {x: left[x].combine_chunks().flatten() for x in ("texts", "ends", "slots", "times")}
    slots, times, ends = (np.asarray(row[x], "i8") for x in ("slots", "times", "ends"))
    summed = []
    for value in (best, counts):
        total = np.concatenate(([0], np.cumsum(times * value[slots])))[np.append(0, ends)]
        summed.append(pa.array(np.diff(total)))
    texts = row["texts"]
    own = [texts.field(x) for x in ("key", "n_a", "n_b", "n_groups", "n_links")]
    names = ["key", *MEASURES, "groups_sha256"]
    return pa.Table.from_arrays([*own, *summed, texts.field("groups_sha256")], names=names)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """key, text, copies: each text that isn't null or empty, once; the full text decides. The key,
    its SHA-256, only carries results back to the rows."""
    rows = docs.select(F.col("text").cast("string").alias("text")).where("text <> ''")
    found = rows.groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return found.select(_key(F.col("text")).alias("key"), "text", "copies")


def _key(text):
    return F.unhex(F.sha2(text, 256))


def measured_texts(docs: DataFrame, rank_file: str, pattern: str, piece_file: str) -> DataFrame:
    """Measures of each distinct text by its key, and with ``n_a`` 0 if it has no tokens."""
    spark = docs.sparkSession
    old = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BLOCK_BYTES))
    try:
        blocks = distinct_texts(docs).mapInArrow(_blocks(rank_file, pattern, piece_file), _BLOCK)
        blocks = staged(blocks.withColumn("block", F.monotonically_increasing_id()), "aligned-blocks")
    finally:
        if old is None:
            spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        else:
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", old)
    wide = encoders(rank_file, pattern, piece_file).b.get_piece_size()
    lists = blocks.select("block", F.explode(F.arrays_zip("pairs", "weights")).alias("x"))
    lists = lists.select("block", F.col("x.pairs").alias("pair"), F.col("x.weights").alias("w"))
    counts = staged(lists.groupBy("pair").agg(F.sum("w").alias("n")), "aligned-pairs")
    first = F.floor(F.col("pair") / wide).cast("int")
    # at most one row for each id of side A
    top = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    counts = counts.withColumn("a", first).join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    found = lists.select(F.col("block").alias("of"), "pair").join(counts, "pair")
    return blocks.drop("pairs", "weights").groupBy("block").cogroup(found.groupBy("of")).applyInArrow(_measured, _RESULT)


def alignment_measures(docs: DataFrame, rank_file: str, pattern: str, piece_file: str) -> DataFrame:
    """doc_id, MEASURES, groups_sha256, one row for each row of ``docs``.

    A null or empty text, or one that either side doesn't spell as a blank and the text, has no
    tokens: zeros and ''. Rows of one text, repeated rows and rows without doc_id each count as a
    document. Other columns are not read; an empty table gives an empty table.
    """
    made = staged(measured_texts(docs, rank_file, pattern, piece_file), "aligned-texts")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"))
    zero = [F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in MEASURES]
    return rows.join(made, "key", "left").select("doc_id", *zero, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def aligned(df: DataFrame, rank_file: str, pattern: str, piece_file: str, text_col: str = "text", out: str = "aligned") -> DataFrame:
    """``df`` with its tokens side by side: ``out``, an array of groups, each with the ids of both
    sides and the byte at which it ends (the blank before the text is byte 0).

    Texts without tokens have no groups. A column named ``out`` is replaced, rows stay as they are.
    """
    df = df.drop(out)
    from pyspark.sql import types as T

    ids = T.ArrayType(T.IntegerType())
    group = T.StructType([T.StructField("a", ids), T.StructField("b", ids), T.StructField("end", T.LongType())])
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(group))])

    def run(batches):
        import numpy as np

        enc = encoders(rank_file, pattern, piece_file)
        for batch in batches:
            made = Batch(enc, batch.column(text_col).to_pylist())
            n = int(made.n_groups.sum())
            parts = []
            for ids, group in ((made.a, made.group_a), (made.b, made.group_b)):
                upto = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=n)))).astype("i4")
                parts.append(pa.ListArray.from_arrays(upto, pa.array(ids)))
            ends = np.cumsum(enc.side_a.sizes[made.a])[np.cumsum(np.bincount(made.group_a, minlength=n)) - 1] if n else np.zeros(0, "i8")
            size = np.bincount(np.repeat(np.arange(made.n), made.n_a), enc.side_a.sizes[made.a], made.n).astype("i8")
            ends = ends - np.repeat(np.cumsum(size) - size, made.n_groups)
            groups = pa.StructArray.from_arrays([*parts, pa.array(ends)], names=["a", "b", "end"])
            offsets = np.concatenate(([0], np.cumsum(made.n_groups))).astype("i4")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, groups)], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)
