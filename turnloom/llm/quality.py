"""Line-first quality rules.

Each line of a text is judged on its own: broken punctuation, navigation, symbol noise,
stuttering, boilerplate phrases, and lines already seen in the document. Failing lines are taken out, and a
document that loses more than ``max_loss`` of its words this way is rejected, as is one that
fails the two base rules (too short, or mostly repeated passages).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed values of the base rules.
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"

#: Share of a document's words that may go with its failing lines.
MAX_LOSS = 0.5

#: Phrases, lower case, that mark a line of at most BOILERPLATE_WORDS words as boilerplate.
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "permission is hereby granted",
    "terms of service",
    "terms of use",
    "privacy policy",
    "cookie policy",
    "accept cookies",
    "uses cookies",
    "enable javascript",
    "click here",
    "sign up for",
    "subscribe to",
    "lorem ipsum",
    "skip to content",
    "back to top",
)
BOILERPLATE_WORDS = 40

_BREAKS = re.compile(r"[.!?:;,…。！？]")
_RUNS = re.compile(r"[!?]{2,}")
_SYMBOL = re.compile(f"[{re.escape(SYMBOLS)}]")
_SPACES = str.maketrans("", "", " \t\n\x0b\x0c\r")

QUALITY = T.StructType(
    [T.StructField(x, T.LongType()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField(x, T.BooleanType()) for x in ("base_failed", "kept")]
    + [T.StructField(x, T.LongType()) for x in ("n_lines_removed", "n_words_removed")]
    + [T.StructField("cleaned", T.StringType())]
)


def repeated_words(words: list, window: int = REPEAT_WINDOW) -> int:
    """Words inside some window of ``window`` words (a power of two) that the text has twice or more.

    Windows are compared exactly: numbers of words are paired up, doubling the length each time.
    """
    import numpy as np

    n = len(words)
    if n <= window:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), "int64", n)
    if len(number) == n:
        return 0
    width = 1
    while width < window:
        base = int(ids.max()) + 1
        _, ids = np.unique(ids[:-width] * base + ids[width:], return_inverse=True)
        width *= 2
    twice = np.bincount(ids)[ids] > 1
    if not twice.any():
        return 0
    edges = np.zeros(n + 1, "int64")
    edges[: len(twice)] += twice
    edges[window : window + len(twice)] -= twice
    return int((np.cumsum(edges)[:n] > 0).sum())


def line_fails(line: str, words: list[bytes]) -> bool:
    """Whether a line that has words breaks a rule by itself."""
    n = len(words)
    symbols = len(_SYMBOL.findall(line))
    if symbols * 2 > n and symbols >= 3:  # noise, or a row of a menu or table
        return True
    if words.count(b"|") * 5 >= n and n >= 3:
        return True
    if n >= 3 and len(_RUNS.findall(line)) * 3 > n:  # shouting
        return True
    if n >= 6 and 2 * sum(a == b for a, b in zip(words, words[1:], strict=False)) > n:  # stuttering
        return True
    if n >= 60 and not _BREAKS.search(line):  # a long run without any punctuation
        return True
    if n <= BOILERPLATE_WORDS:
        low = line.lower()
        return any(phrase in low for phrase in BOILERPLATE)
    return False


def assess(text: str | None, max_loss: float = MAX_LOSS) -> tuple:
    """The fields of QUALITY for one text; null counts as empty and is rejected as too short."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    seen: set[str] = set()
    kept, dups, lines_removed, words_removed = [], 0, 0, 0
    for line in text.split("\n"):
        own = line.encode().split()
        if not own:
            kept.append(line)
            continue
        again = line in seen
        seen.add(line)
        dups += again
        if again or line_fails(line, own):
            lines_removed += 1
            words_removed += len(own)
        else:
            kept.append(line)
    repeats = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    good = not failed and words_removed <= max_loss * n
    return (
        n,
        len(text.translate(_SPACES)),
        len(_SYMBOL.findall(text)),
        dups,
        repeats,
        failed,
        good,
        lines_removed,
        words_removed,
        "\n".join(kept).strip("\n") if lines_removed else text,
    )


def assessed(df: DataFrame, text_col: str = "text", out: str = "quality", max_loss: float = MAX_LOSS) -> DataFrame:
    """``df`` with the struct QUALITY as column ``out``, one row for each row.

    Texts that are null or have no words get n_words 0, base_failed true and kept false. A column
    named ``out`` is replaced; other columns, nulls and repeated rows pass through unchanged.
    """
    df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, QUALITY)])

    def run(batches):
        import pyarrow as pa

        kind = pa.struct(
            [
                (f.name, {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[f.dataType.simpleString()])
                for f in QUALITY.fields
            ]
        )
        for batch in batches:
            rows = [assess(text, max_loss) for text in batch.column(text_col).to_pylist()]
            columns = [pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), kind, strict=True)]
            if rows:
                made = pa.StructArray.from_arrays(columns, fields=list(kind))
                yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)
