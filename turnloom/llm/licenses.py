"""License scans by diagonal voting.

Every window of GRAM words of every text is joined, by its hash, to the places where the license
templates have the same window, and compared word by word. A hit at word p of the text and word q
of the template votes for the diagonal p - q. The votes of a diagonal are added up, neighbouring
diagonals (a word more or less than the template) are merged into one span, and the span is
verified: the share of the template's words that its windows cover must reach MIN_SHARE, and no
span that overlaps it in the text may cover more of its own template.

The templates are few and fixed, so the table of their windows has a size bound (MAX_GRAMS) and
is broadcast; texts are not shuffled, hits are keyed by the digest of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import LOWER, UPPER, staged
from turnloom.llm.substring import Hasher

GRAM = 4
MIN_SHARE = 0.8
#: Windows of all templates together; more raise, since they are broadcast.
MAX_GRAMS = 200_000
#: Words that may stand between two hits of a span.
GAP = 12

#: Phrases whose places are counted, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Notices that the licenses give or that projects use, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("gpl-2", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl-3", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("lgpl-2.1", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("lgpl-3", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("agpl-3", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("boost", "Distributed under the Boost Software License, Version 1.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
)

#: ASCII letters and digits and whatever is not ASCII belong to words; the rest parts them.
_INSIDE = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_APART = bytes.maketrans(
    bytes(range(256)),
    bytes(c if c in _INSIDE else 0x20 for c in bytes(range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))),
)


def parted(text: str | None) -> bytes:
    """The text in UTF-8, A-Z in lower case, with blanks for what isn't part of a word."""
    return (text or "").encode().translate(_APART)


def _phrase_places(words: list, phrases: dict) -> list:
    """(start, label) of every place of a phrase."""
    found = []
    for phrase, label in phrases.items():
        own = phrase.encode().split()
        at = -1
        for _ in range(words.count(own[0])):
            at = words.index(own[0], at + 1)
            if words[at : at + len(own)] == own:
                found.append((at, label))
    return found


def _based(phrases: dict):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = []
            for text in batch.column("text").to_pylist():
                words = parted(text).split()
                found = _phrase_places(words, phrases)
                at = [x[0] for x in found]
                made.append((len(words), len(found), min(at, default=None), max(at, default=None), sorted({x[1] for x in found})))
            columns = [pa.array(x, t) for x, t in zip(zip(*made, strict=True), (*[pa.int64()] * 4, pa.list_(pa.string())), strict=True)] if made else []
            if made:
                own = [batch.column("doc_id"), batch.column("tag"), *columns]
                yield pa.RecordBatch.from_arrays(own, names=["doc_id", "tag", "n_words", "n_base", "first_word", "last_word", "base"])

    return run


def _hashed(gram: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        hasher = Hasher()
        for batch in batches:
            texts = [parted(x) for x in batch.column("text").to_pylist()]
            hashes, starts, _, _ = hasher.texts(texts)
            grams = hasher.windows(hashes, gram).view("i8")
            ends = np.append(starts, len(hashes))
            n = np.maximum(np.diff(ends) - gram + 1, 0)
            offsets = np.concatenate(([0], np.cumsum(n)))
            place = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - ends[:-1], n)
            lists = pa.ListArray.from_arrays(offsets.astype("i4"), pa.array(grams[place]))
            words = pa.array([x.decode().split(" ") if x else [] for x in (b" ".join(t.split()) for t in texts)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("tag"), lists, words], names=["tag", "grams", "words"])

    return run


def template_grams(spark, templates=TEMPLATES, gram: int = GRAM) -> DataFrame:
    """g, template, label, size, q, own: the hash, place and words of each window of a template."""
    rows, hasher = [], Hasher()
    for number, (label, text) in enumerate(templates):
        words = parted(text).split()
        if len(words) < gram:
            raise ValueError(f"a template of {len(words)} words has no window of {gram}")
        hashes, _, _, _ = hasher.texts([b" ".join(words)])
        for q, h in enumerate(hasher.windows(hashes, gram).view("i8").tolist()):
            rows.append((h, number, label, len(words), q, b" ".join(words[q : q + gram]).decode()))
    if len(rows) > MAX_GRAMS:
        raise ValueError(f"{len(rows)} windows of templates are over {MAX_GRAMS}")
    return spark.createDataFrame(rows, "g long, template int, label string, size int, q int, own string")


def _tagged(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("tag"))


def hits(docs: DataFrame, templates=TEMPLATES, gram: int = GRAM) -> DataFrame:
    """tag, template, label, size, p, q: every window of every text that a template has too."""
    listed = _tagged(docs).select("tag", "text").mapInArrow(_hashed(gram), "tag binary, grams array<bigint>, words array<string>")
    each = listed.select("tag", "words", F.posexplode("grams").alias("p", "g"))
    joined = each.join(F.broadcast(template_grams(docs.sparkSession, templates, gram)), "g")
    same = F.array_join(F.slice("words", F.col("p") + 1, F.lit(gram)), " ") == F.col("own")
    return joined.where(same).select("tag", "template", "label", "size", "p", "q")


def diagonals(found: DataFrame) -> DataFrame:
    """The votes of each diagonal: its places in the template, at most the template's words."""
    kept = ["tag", "template", "label", "size", (F.col("p") - F.col("q")).alias("diagonal"), "q"]
    rows = found.select(*kept).groupBy("tag", "template", "label", "size", "diagonal")
    return rows.agg(F.array_sort(F.collect_set("q")).alias("places"))


def spans(votes: DataFrame, gram: int = GRAM) -> DataFrame:
    """tag, template, label, first_word, last_word, share: neighbouring diagonals merged, with the
    share of the template's words they cover.

    Diagonals are neighbours if one begins at most GAP words behind what came before in the text
    and they lie at most a quarter of the template apart.
    """
    first = F.col("diagonal") + F.element_at("places", 1)
    last = F.col("diagonal") + F.element_at("places", -1) + (gram - 1)
    rows = votes.select("*", first.alias("first"), last.alias("last"))
    order = Window.partitionBy("tag", "template").orderBy("first", "diagonal")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    apart = F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > F.ceil(F.col("size") / 4)
    new = F.coalesce(apart | (F.col("first") > F.max("last").over(before) + GAP), F.lit(True))
    rows = rows.withColumn("new", new.cast("int")).withColumn("span", F.sum("new").over(order))
    covered = F.transform("places", lambda q: F.sequence(q, q + (gram - 1)))
    rows = rows.withColumn("covered", F.array_distinct(F.flatten(covered)))
    made = rows.groupBy("tag", "template", "label", "size", "span").agg(
        F.min("first").cast("long").alias("first_word"),
        F.max("last").cast("long").alias("last_word"),
        F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("n"),
    )
    return made.select("tag", "template", "label", "first_word", "last_word", (F.col("n") / F.col("size")).alias("share"))


def verified(found: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """The spans that cover enough of their template; of those that overlap in the text, the ones
    with the largest share, so that of two versions of a license the one that stands there wins."""
    order = Window.partitionBy("tag").orderBy("first_word", "last_word", "template")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.col("first_word") > F.max("last_word").over(before), F.lit(True))
    rows = found.where(F.col("share") >= min_share).withColumn("new", new.cast("int")).withColumn("place", F.sum("new").over(order))
    most = F.max("share").over(Window.partitionBy("tag", "place"))
    return rows.withColumn("most", most).where("share = most").drop("new", "place", "most")


def scanned(docs: DataFrame, templates=TEMPLATES, phrases: dict = PHRASES, gram: int = GRAM, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, one row a row.

    A null text counts as empty: no words, no labels, score 0. Rows of one doc_id are judged by
    their own texts; repeated rows give repeated rows; an empty table gives an empty table. Columns
    besides doc_id and text are not read. The score is the largest share of a template that a span
    covers, 1 where a phrase stands.
    """
    tagged = _tagged(docs)
    schema = "doc_id long, tag binary, n_words long, n_base long, first_word long, last_word long, base array<string>"
    base = tagged.select(F.col("doc_id").cast("long"), "tag", "text").mapInArrow(_based(phrases), schema)
    # written first: joins of plain shuffles can be split where many rows have one text
    found = staged(spans(diagonals(hits(docs, templates, gram)), gram), "license-spans")
    labelled = verified(found, min_share).groupBy("tag").agg(F.collect_set("label").alias("found"))
    own = staged(found.groupBy("tag").agg(F.max("share").alias("share")).join(labelled, "tag", "left"), "license-labels")
    rows = base.join(own, "tag", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )


def located(docs: DataFrame, templates=TEMPLATES, gram: int = GRAM, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, label, template, first_word, last_word, share of every verified span, for each row."""
    found = verified(spans(diagonals(hits(docs, templates, gram)), gram), min_share)
    return _tagged(docs).select("doc_id", "tag").join(staged(found, "license-spans"), "tag").drop("tag")
