"""Training-corpus pipeline: quality, exact dedup, near dedup, pseudonyms, packing.

Each stage takes the documents that the one before it kept and returns documents with the same
columns; the last returns packed pieces. Every decision follows from the stage's own input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import exact, packing, pii, quality, simhash
from turnloom.llm.common import arrow_rows, fresh, staged
from turnloom.llm.queries import PII_KEY


def _as_documents(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``docs``; n_chars follows the text if there is one."""
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go from the texts, and documents that the rules reject go. A null text goes."""
    arrow_rows(spark)
    (out,) = fresh(docs, "quality")
    rows = quality.assessed(docs, out=out).where(F.col(out)["kept"])
    return _as_documents(rows.withColumn("text", F.col(out)["cleaned"]), docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays; of repeated rows, one."""
    return exact.survivors(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document with the smallest doc_id stays.

    Null and empty texts are one component, very long ones are read whole. Rows of one doc_id with
    different texts are judged one by one, and equal rows stay or go together. Rows without a
    doc_id stay if their component has no row with one.
    """
    arrow_rows(spark)
    tag, own_id, own_tag = fresh(docs, "tag", "own_id", "own_tag")
    docs_tagged = docs.withColumn(tag, F.xxhash64("text"))
    near = simhash.near_duplicates(docs_tagged, carry=(tag,))
    stay = near.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(own_id), F.col(tag).alias(own_tag))
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(tag) == F.col(own_tag))
    return docs_tagged.join(stay, same, "left_semi").drop(tag)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to pseudonyms of the same format.

    Every row stays; a null text stays null, and equal rows get equal texts.
    """
    return _as_documents(pii.pseudonymised(docs, PII_KEY, count_col=fresh(docs, "n_pii")[0]), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as token pieces with their places in sequences of 2,048 tokens.

    A null or empty text is one piece, its end; a long text gives as many as it needs; equal rows
    get places of their own.
    """
    arrow_rows(spark)
    pieces = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return packing.pack(staged(pieces, "pieces"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("PII pseudonyms", pseudonyms),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return last(spark, docs, sf_dir)
