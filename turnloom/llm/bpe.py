"""Byte-level BPE: encode texts to token ids and decode ids to raw bytes.

The ids are those of tiktoken for the given rank file, without special tokens. Long texts are
encoded piece by piece. A cut is only made where a character that is not white space meets a
blank or a newline: every alternative of the splitting pattern takes white space at its start
only, so such a place always lies between two matches, and no match before it looks past it.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Characters of a piece before the next safe cut is looked for.
PIECE_CHARS = 16_384

_SAFE = re.compile(r"(?<=\S)(?=[ \n])")
#: White space as the pattern of the encoding has it, in runs that are cut out.
_LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a local rank file; kept for the life of a Python worker."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, piece_chars: int = PIECE_CHARS) -> Iterator[str]:
    """Cut ``text`` into pieces whose encodings, joined, are the encoding of the whole.

    A text without a safe place after ``piece_chars`` characters stays in one piece.
    """
    start = 0
    while len(text) - start > piece_chars:
        cut = _SAFE.search(text, start + piece_chars)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc, text: str | None, piece_chars: int = PIECE_CHARS) -> list[int]:
    """The ids of ``text``; a null text has none."""
    ids: list[int] = []
    text, start = text or "", 0
    for run in _LONG_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        for piece in safe_pieces(text[start : run.start()], piece_chars):
            ids += enc.encode_ordinary(piece)
        ids += enc._encode_single_piece(text[run.start() : end])
        start = end
    for piece in safe_pieces(text[start:], piece_chars):
        ids += enc.encode_ordinary(piece)
    return ids


def encode(
    df: DataFrame,
    rank_file: str,
    pattern: str,
    text_col: str = "text",
    ids_col: str = "token_ids",
    piece_chars: int = PIECE_CHARS,
) -> DataFrame:
    """``df`` with ``ids_col`` array<int>, the ids of ``text_col``.

    A null or empty text gives an empty array. Rows, repeated ones too, stay as they are; an
    input column named ``ids_col`` is replaced; an empty table gives an empty table.
    """
    df = df.drop(ids_col)
    schema = T.StructType([*df.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        enc = encoding(rank_file, pattern)
        for batch in batches:
            offsets, ids = [0], []
            for text in batch.column(text_col).to_pylist():
                ids += encode_text(enc, text, piece_chars)
                offsets.append(len(ids))
            lists = pa.ListArray.from_arrays(np.array(offsets, "int32"), pa.array(np.array(ids, "int32")))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, ids_col])

    return df.mapInArrow(run, schema)


def decode(
    df: DataFrame, rank_file: str, pattern: str, ids_col: str = "token_ids", bytes_col: str = "decoded"
) -> DataFrame:
    """``df`` with ``bytes_col`` binary, the raw bytes of the ids in ``ids_col``.

    Bytes, not text: a cut list of ids may end inside a character. Null or empty ids give empty
    bytes; an id outside the rank file raises. A column named ``bytes_col`` is replaced.
    """
    df = df.drop(bytes_col)
    schema = T.StructType([*df.schema.fields, T.StructField(bytes_col, T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        enc = encoding(rank_file, pattern)
        for batch in batches:
            raw = [enc.decode_bytes(ids or []) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(raw, pa.binary())], names=[*batch.schema.names, bytes_col]
            )

    return df.mapInArrow(run, schema)
