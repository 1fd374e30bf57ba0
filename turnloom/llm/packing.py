"""Best-fit packing of token pieces into sequences, after Martello-Toth reduction.

Only the counts of the lengths decide the packing, and there are at most ``capacity`` lengths.
So Spark counts the lengths, the plan is made over that bounded histogram, and pieces take
their places by their rank among the pieces of equal length.

The reduction fixes sets that dominate every other set their largest piece could be in: the
piece alone if nothing fits beside it, with a piece that fills the sequence exactly, with the
largest fitting piece if no two others fit, or with the two largest if every other pair could be
exchanged for them. What no rule proves is packed best-fit, longest first.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm.common import staged

CAPACITY = 2048

Pattern = tuple[tuple[int, int], ...]  # (length, copies) in the order of the places


def _largest(counts: list[int], most: int) -> int:
    while most > 0 and not counts[most]:
        most -= 1
    return max(most, 0)


def _smallest(counts: list[int], how_many: int, most: int) -> list[int]:
    found: list[int] = []
    for length in range(1, most + 1):
        found += [length] * min(counts[length], how_many - len(found))
        if len(found) == how_many:
            break
    return found


def dominating(counts: list[int], item: int, capacity: int) -> tuple[int, ...] | None:
    """The companions of one ``item`` in a set that provably dominates all its others, or None.

    ``counts`` has the pieces beside it. Sets dominate by exchange: each piece, or group of
    pieces, of any other set is at most as long as the companion it would be exchanged for.
    """
    room = capacity - item
    first = _largest(counts, room)
    if not first:
        return ()
    if first == room:
        return (first,)
    least = _smallest(counts, 3, room)
    if len(least) < 2 or least[0] + least[1] > room:
        return (first,)
    if len(least) == 3 and sum(least) <= room:
        return None
    counts[first] -= 1
    second = _largest(counts, room - first)
    counts[first] += 1
    for low in range(second + 1, room // 2 + 1):  # a pair that neither exchange covers
        if counts[low]:
            counts[low] -= 1
            high = _largest(counts, room - low)
            counts[low] += 1
            if high >= low and high + low > first:
                return None
    return (first, second) if second else (first,)


def reduce(counts: list[int], capacity: int) -> list[tuple[Pattern, int]]:
    """Take dominating sets out of ``counts`` until none is left to prove; the sets and how often."""
    fixed: list[tuple[Pattern, int]] = []
    changed = True
    while changed:
        changed = False
        for item in range(capacity, 0, -1):
            while counts[item]:
                counts[item] -= 1
                rest = dominating(counts, item, capacity)
                counts[item] += 1
                if rest is None:
                    break
                need: dict[int, int] = {}
                for length in (item, *rest):
                    need[length] = need.get(length, 0) + 1
                times = min(counts[length] // k for length, k in need.items())
                for length, k in need.items():
                    counts[length] -= k * times
                fixed.append((tuple(need.items()), times))
                changed = True
    return fixed


def best_fit(counts: list[int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over counts; sequences that look alike are handled together."""
    open_at: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if room not in open_at:
            open_at[room] = []
            insort(rooms, room)
        open_at[room].append((pattern, times))

    for length in range(capacity, 0, -1):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                pattern, times = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room], rooms[at]
            else:
                room, pattern, times = capacity, (), left
            each = min(room // length, left)
            used = min(times, left // each)
            if used < times and pattern:
                put(room, pattern, times - used)
            put(room - each * length, (*pattern, (length, each)), used)
            left -= used * each
    return [x for room in rooms for x in open_at[room]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Places by rank: (length, first rank, end rank, copies a sequence, first sequence, offset).

    The pieces of ``length`` with ranks from first to end fill consecutive sequences, so many
    copies in each, from ``offset`` on. Its size depends on ``capacity``, not on the pieces.
    """
    counts = [histogram.get(length, 0) for length in range(capacity + 1)]
    sets = reduce(counts, capacity)
    sets += best_fit(counts, capacity)
    places, rank, sequence = [], [0] * (capacity + 1), 0
    for pattern, times in sets:
        offset = 0
        for length, copies in pattern:
            end = rank[length] + copies * times
            places.append((length, rank[length], end, copies, sequence, offset))
            rank[length] = end
            offset += length * copies
        sequence += times
    return places


#: Texts of these characters only (Latin, Greek, Cyrillic, dashes and quotes), without U+0130,
#: are split into parts here; the tokenizer's own classes agree on them.
_PLAIN = re.compile("[^\\x00-\u012f\u0131-\u04ff\u2010-\u2027\u2030-\u205e]")
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
#: What the tokenizer file splits off after an apostrophe, and white space.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@functools.lru_cache(maxsize=1)
def _classes():
    """The class of each code point of plain texts."""
    import numpy as np
    import regex

    made = np.full(0x2060, _OTHER, "u1")
    for kind, pattern in ((_LETTER, r"\p{L}"), (_DIGIT, r"\p{N}"), (_SPACE, f"[{_BLANK}]")):
        made[[i for i in range(len(made)) if regex.fullmatch(pattern, chr(i))]] = kind
    return made


class WordEncoder:
    """Token ids of texts by a ``tokenizers`` file, many texts at a time.

    The tokenizer of the file composes characters, maps case, splits a text by a pattern, drops
    the white space and encodes each part by itself. So the ids of a text are those of its parts
    one after the other, and each distinct part of a batch is encoded once. Texts with characters
    outside the plain ranges, not composed, or with the content of an added token are encoded
    whole by the library. ``whole`` does so with all, for files where none of this holds.
    """

    def __init__(self, tokenizer_file: str, whole: bool = False):
        self.file, self.whole = tokenizer_file, whole

    @functools.cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.file)

    @functools.cached_property
    def added(self) -> list[str]:
        return [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]

    @functools.cached_property
    def merger(self):
        from turnloom.llm.wordbpe import WordMerger

        return WordMerger(self.file)

    def _library_ids(self, text: str):
        import numpy as np

        # one at a time: an encoding takes far more room than its ids
        (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, "u4")

    def plain(self, text: str) -> bool:
        return not (
            self.whole or _PLAIN.search(text) or any(x in text for x in self.added) or not unicodedata.is_normalized("NFC", text)
        )

    def parts(self, texts: list[str]):
        """The parts of plain lower-case texts as a dictionary array, and the place of each text's first."""
        import numpy as np
        import pyarrow as pa

        points = np.frombuffer("\n".join(texts).encode("utf-32-le"), "<u4")
        kind = _classes()[points]
        begins = np.ones(len(points), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        for at in np.flatnonzero(begins & (points == ord("'"))).tolist():
            after = points[at + 1 : at + 3].tobytes().decode("utf-32-le")
            ending = next((x for x in _ENDINGS if after.startswith(x)), "")
            if ending:  # the ending belongs to the apostrophe, and a new part begins behind it
                begins[at + 1] = False
                if at + 1 + len(ending) < len(points):
                    begins[at + 1 + len(ending)] = True
        start = np.flatnonzero(begins)
        width = 1 + (points > 0x7F).astype("i8") + (points > 0x7FF)
        place = np.concatenate(([0], np.cumsum(width)))
        offsets = np.append(place[start], place[-1])
        raw = pa.py_buffer("\n".join(texts).encode())
        made = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), raw)
        words = kind[start] != _SPACE
        lengths = np.fromiter(map(len, texts), "i8", len(texts)) + 1
        first = np.searchsorted(start[words], np.cumsum(lengths) - lengths)
        return made.filter(pa.array(words)).dictionary_encode(), first

    def _distinct_ids(self, words):
        """Flat ids of distinct parts and where those of each begin and end."""
        import numpy as np
        import pyarrow.compute as pc

        from turnloom.llm.wordbpe import LONGEST

        long = pc.greater(pc.binary_length(words), LONGEST).to_numpy(zero_copy_only=False)
        if not long.any():
            return self.merger(words)
        ids, ends = self.merger(words.filter(pc.invert(long)))
        made = [self._library_ids(x) for x in words.filter(long).to_pylist()]
        size = np.empty(len(words), "i8")
        size[~long], size[long] = np.diff(ends), [len(x) for x in made]
        flat = np.empty(size.sum(), "u4")
        from_long = np.repeat(long, size)
        flat[~from_long], flat[from_long] = ids, np.concatenate(made)
        return flat, np.concatenate(([0], np.cumsum(size)))

    def encode(self, texts: list[str], end_id: int):
        """Flat ids of all texts, each followed by ``end_id``, and where those of each begin and end."""
        import numpy as np

        plain = [self.plain(x) for x in texts]
        words, first = self.parts([_lower(x) if ok else "" for x, ok in zip(texts, plain, strict=True)])
        flat, ends = self._distinct_ids(words.dictionary) if len(words) else (np.zeros(0, "u4"), np.zeros(1, "i8"))
        # one more part: the end; and one for each text that the library encodes
        rest = [self._library_ids(x) for x, ok in zip(texts, plain, strict=True) if not ok]
        flat = np.concatenate((flat, [end_id], *rest)).astype("u4")
        sizes = np.concatenate((np.diff(ends), [1], [len(x) for x in rest])).astype("i8")
        begin = np.cumsum(sizes) - sizes
        n = len(words.dictionary)
        last = np.append(first[1:], len(words))
        odd = np.flatnonzero(~np.array(plain, bool))
        order = np.argsort(np.concatenate((odd, np.arange(len(last)))), kind="stable")  # a text's ids, then its end
        at = np.concatenate((last[odd], last))[order]
        part = np.insert(words.indices.to_numpy(), at, np.concatenate((n + 1 + np.arange(len(odd)), np.full(len(last), n)))[order])
        per = np.diff(np.append(first, len(words))) + 1
        per[odd] += 1
        size = sizes[part]
        ids = flat[np.repeat(begin[part] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        return ids, np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(per)))]


def _lower(text: str) -> str:
    """Each character in lower case by itself, as the tokenizer does it: no final sigma."""
    return "".join(map(str.lower, text)) if "\u03a3" in text else text.lower()


@functools.lru_cache(maxsize=2)
def _encoder(tokenizer_file: str, whole: bool) -> WordEncoder:
    """Kept for the life of a Python worker."""
    return WordEncoder(tokenizer_file, whole)


def pieces(
    docs: DataFrame,
    tokenizer_file: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    with_ids: bool = True,
    whole: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of every document's pieces.

    A document's ids end with ``end_id``. Only a document longer than ``capacity`` is cut. A null
    or empty text is the end id alone; a null doc_id stays null; repeated rows give their pieces
    again. Columns beside doc_id and text are not read.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encoder = _encoder(tokenizer_file, whole)
        for batch in batches:
            if not len(batch):
                continue
            ids, ends = encoder.encode([x or "" for x in batch.column("text").to_pylist()], end_id)
            n_pieces = -(-np.diff(ends) // capacity)
            owner = np.repeat(np.arange(len(batch)), n_pieces)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            start = piece * capacity
            length = np.minimum(np.diff(ends)[owner] - start, capacity)
            raw, at = memoryview(ids.astype("<u4").tobytes()), ends[owner] + start
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            columns = [batch.column("doc_id").take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            if with_ids:
                offsets = np.append(at, len(ids)).astype("int32")
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(ids.view("i4"))))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, schema
    )


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``made`` (a staged table with doc_id, piece and length) with sequence_id and offset.

    Every row gets a place of its own, repeated rows too. Ranks within one length are counted
    in as many parts as there are shuffle partitions, so a length that most pieces share does
    not meet in one task. The histogram that reaches the driver has at most ``capacity`` rows.
    """
    spark = made.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = made.drop("sequence_id", "offset")
    rows = made.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    counts = staged(rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    if not histogram:
        return made.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    counts = counts.select("length", "part", before.alias("before"))
    fields = ("length", "first", "end", "copies", "sequence", "at")
    places = spark.createDataFrame(
        plan(histogram, capacity), T.StructType([T.StructField(x, T.LongType()) for x in fields])
    )
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece"))
    ranked = (
        rows.withColumn("within", within)
        .join(counts.hint("merge"), ["length", "part"])
        .withColumn("rank", F.col("before") + F.col("within") - 1)
    )
    here = places.withColumnRenamed("length", "place_length")
    placed = ranked.join(
        F.broadcast(here),
        (F.col("length") == F.col("place_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")),
    )
    k = F.col("rank") - F.col("first")
    return placed.select(
        *made.columns,
        (F.col("sequence") + F.floor(k / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("at") + k % F.col("copies") * F.col("length")).cast("long").alias("offset"),
    )
