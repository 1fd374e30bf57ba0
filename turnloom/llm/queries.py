"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import alignment, bpe, centroids, exact, licenses, packing, pii, quality, rollup, simhash, substring, toxicity, warc
from turnloom.llm.common import arrow_rows, shared_dir, staged, table


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    arrow_rows(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, ranks, pattern).drop("text")
    both = bpe.decode(ids, ranks, pattern)

    def digests(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            ids = [x.values.to_numpy().astype("<u4") for x in batch.column("token_ids")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]),
                    batch.column("decoded"),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded"],
            )

    rows = both.mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded binary")
    return rows.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact.dedup(table(spark, sf_dir, "documents"))
    return rows.withColumnRenamed("digest", "text_sha256")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


#: A secret of the deployment; the value here only serves the registered query.
PII_KEY = "registered-query-key"


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymised(docs, PII_KEY)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.assessed(docs).select(
        "doc_id",
        *[
            F.col(f"quality.{x}").alias(x)
            for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
        ],
        F.col("quality.n_words_removed").alias("n_words_removed"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    docs = table(spark, sf_dir, "documents")
    made = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return packing.pack(staged(made, "pieces"))


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    return substring.deduplicated(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows = toxicity.scored(docs, model)
    return rows.select(
        "doc_id",
        F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),  # a null id has no remainder
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark, 500)
    path = shared_dir(spark, "warc")
    manifest = warc.write(table(spark, sf_dir, "pages"), path)
    records = warc.read(manifest, path)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents enter with an estimate of their tokens and no language; when that is known they are
    deleted and inserted anew, then revised to the exact count, which is sent twice, as after a
    lost reply."""
    arrow_rows(spark)
    file = "byte_bpe_multi_50k.tiktoken"
    docs = table(spark, sf_dir, "documents").select("source", "lang", "text")
    ids = bpe.encode(docs, public_tokenizers.path(file), public_tokenizers.PATTERN)
    estimate = F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / 4).alias("estimate")
    rows = ids.select("source", "lang", F.lit(file).alias("tokenizer"), estimate, F.size("token_ids").alias("tokens"))
    rows = staged(rows, "token-counts")
    totals = rollup.TokenRollup(spark, shared_dir(spark, "rollup"))
    keys = ("source", "lang", "tokenizer")
    entered = rows.select("source", F.lit(None).cast("string").alias("lang"), "tokenizer", F.col("estimate").alias("tokens"), F.lit(0).alias("old_tokens"))
    known = rows.select(*keys, F.col("estimate").alias("tokens"), F.lit(0).alias("old_tokens"))
    as_op = lambda op, df: df.select(F.lit(op).alias("op"), "*")
    totals.apply("load", as_op("insert", entered))
    totals.apply("languages", as_op("delete", entered).unionByName(as_op("insert", known)))
    revised = rows.select(F.lit("revise").alias("op"), *keys, "tokens", F.col("estimate").alias("old_tokens"))
    totals.apply("exact", revised)
    totals.apply("exact", revised)
    return totals.totals()


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    files = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.alignment_measures(table(spark, sf_dir, "documents"), *files)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark, 10_000)
    return centroids.described(centroids.clustered(table(spark, sf_dir, "embeddings")))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    return licenses.scanned(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_substring": op1_substring,
    "op2_bpe": op2_bpe,
    "op3_warc": op3_warc,
    "op4_simhash": op4_simhash,
    "op5_pii": op5_pii,
    "op6_token_counts": op6_token_counts,
    "op7_quality": op7_quality,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_alignment": op11_alignment,
    "op12_centroids": op12_centroids,
    "op13_licenses": op13_licenses,
}

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

_SUBSTRING = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM d WHERE len(ws) >= 13),
keyed AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM win),
firsts AS (SELECT k, min(doc_id) AS m FROM keyed GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(13)) AS j FROM keyed JOIN firsts USING (k) WHERE m < doc_id)),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM w ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_PHRASES = "[" + ", ".join(f"'{x}'" for x in quality.BOILERPLATE) + "]"
_QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
lines AS (SELECT doc_id, line, i, {_WORDS.replace("coalesce(text, '')", "line")} AS own
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)),
judged AS (SELECT doc_id, len(own) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again,
    len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols, len(list_filter(own, lambda x: x = '|')) AS bars,
    len(regexp_extract_all(line, '[!?]{{2,}}')) AS runs, regexp_matches(line, '[.!?:;,…。！？]') AS breaks,
    len(list_filter(range(1, len(own)), lambda k: own[k] = own[k + 1])) AS stutters,
    len(list_filter({_PHRASES}, lambda x: contains(lower(line), x))) > 0 AS phrase
  FROM lines WHERE len(own) > 0),
verdicts AS (SELECT doc_id, n, again, again OR (symbols * 2 > n AND symbols >= 3) OR (bars * 5 >= n AND n >= 3) OR (n >= 3 AND runs * 3 > n)
    OR (n >= 6 AND 2 * stutters > n) OR (n >= 60 AND NOT breaks) OR (n <= {quality.BOILERPLATE_WORDS} AND phrase) AS fails FROM judged),
by_line AS (SELECT doc_id, count(*) FILTER (again) AS dups, coalesce(sum(n) FILTER (fails), 0) AS lost FROM verdicts GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
reps AS (SELECT doc_id, count(DISTINCT p) AS reps FROM (SELECT doc_id, i + unnest(range(8)) AS p FROM twice) GROUP BY doc_id),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dups, 0)::BIGINT AS n_dup_lines,
    coalesce(reps, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS n_words_removed
  FROM d LEFT JOIN by_line USING (doc_id) LEFT JOIN reps USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words_removed <= 0.5 * n_words AS kept
FROM f
"""



def _rounds(n: int) -> str:
    """The assignments and centroids of ``n`` rounds and the last assignment, as further CTEs."""
    near = """a{i} AS MATERIALIZED (SELECT i, v, arg_min(c, (far, c)) AS cluster, min(far) AS distance FROM
  (SELECT i, v, c, list_sum(list_transform(list_zip(v, mid), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS far FROM k, c{i}) GROUP BY i, v)"""
    mean = """m{i} AS (SELECT cluster, p, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS p FROM a{i}) GROUP BY cluster, p),
c{j} AS MATERIALIZED (SELECT c, coalesce(new, mid) AS mid FROM c{i} LEFT JOIN
  (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS new FROM m{i} GROUP BY cluster) ON c = cluster)"""
    parts = [x for i in range(n) for x in (near.format(i=i), mean.format(i=i, j=i + 1))]
    return ",\n".join([*parts, near.format(i=n)])


_CENTROIDS = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS mid FROM
  (SELECT sha256('{centroids.SEED}:' || vec_id) AS h, v FROM k ORDER BY h NULLS LAST, v LIMIT {centroids.CLUSTERS})),
{_rounds(centroids.ROUNDS)}
SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(mid, ',')) AS centroid_sha256
FROM a{centroids.ROUNDS} JOIN k USING (i) JOIN c{centroids.ROUNDS} ON c = cluster
"""

ORACLES = {
    "op1_substring": _SUBSTRING,
    "op7_quality": _QUALITY,
    "op12_centroids": _CENTROIDS,
    "op10_exact_dedup": """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM n
""",
}
