"""Registered queries of the training-data operators, and their SQL twins where SQL can say it."""

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stromlage.llm.backoff import backoff_scores
from stromlage.llm.common import documents
from stromlage.llm.fingerprints import compare_with_next
from stromlage.llm.hnsw import nearest_neighbours
from stromlage.llm.jaccard_join import linked_documents
from stromlage.llm.lexical import best_documents
from stromlage.llm.line_dedup import line_decisions
from stromlage.llm.packing import pack
from stromlage.llm.pieces import decode, encode
from stromlage.llm.pseudonyms import pseudonymise
from stromlage.llm.quality import judge
from stromlage.llm.repair import damage, repair
from stromlage.llm.suffix_dedup import remove_repeats
from stromlage.llm.token_counts import token_counts

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(documents(spark, sf_dir), BYTE_BPE)
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


@query("op7_fingerprints")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(documents(spark, sf_dir))


@query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))


#: Not a secret: pseudonyms of test tables only. Real runs pass a key of their own.
KEY = "stromlage"


@query("op9_pseudonyms")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", F.col("text").alias("_before"))
    return pseudonymise(docs, KEY).select(
        "doc_id", "text", (~F.col("text").eqNullSafe(F.col("_before"))).alias("changed")
    )


@query("op4_line_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_decisions(documents(spark, sf_dir))


# All pairs of sets by brute force; components by reachability.
OP10_SQL = r"""
WITH RECURSIVE cut AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), grams AS (
    SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
        WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g
    FROM cut
), sizes AS (
    SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
    FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM shared JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c >= 85 * (s.n + t.n - c)
), both_ways AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
"""


@query("op10_ngram_jaccard", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(documents(spark, sf_dir))


@query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), BYTE_BPE, BYTE_BPE_RANKS, public_tokenizers.PATTERN)


OP6_SQL = r"""
WITH cut AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), positions AS (
    SELECT doc_id, len(ws) AS n_words, unnest(list_concat(['', ''], ws[:-3])) AS u,
        unnest(list_prepend('', ws[:-2])) AS v, unnest(ws) AS w FROM cut WHERE len(ws) > 1
    UNION ALL SELECT doc_id, 1, '', '', ws[1] FROM cut WHERE len(ws) = 1
), own AS (
    SELECT doc_id, n_words, u, v, w, count(*) AS n FROM positions GROUP BY ALL
), held AS (
    SELECT *, sum(n) OVER (PARTITION BY u, v, w) - n AS c3,
        sum(n) OVER (PARTITION BY u, v) - sum(n) OVER (PARTITION BY doc_id, u, v) AS before3,
        sum(n) OVER (PARTITION BY v, w) - sum(n) OVER (PARTITION BY doc_id, v, w) AS c2,
        sum(n) OVER (PARTITION BY v) - sum(n) OVER (PARTITION BY doc_id, v) AS before2,
        sum(n) OVER (PARTITION BY w) - sum(n) OVER (PARTITION BY doc_id, w) AS c1,
        sum(n) OVER () - n_words AS others
    FROM own
), scored AS (
    SELECT doc_id, n, c3 = 0 AS unseen, c3 = 0 AND c2 = 0 AS alone,
        CASE WHEN c3 > 0 THEN ln(c3::DOUBLE / before3::DOUBLE)
             WHEN c2 > 0 THEN ln(0.4) + ln(c2::DOUBLE / before2::DOUBLE)
             ELSE 2 * ln(0.4) + ln(greatest(c1, 1)::DOUBLE / greatest(others, 1)::DOUBLE) END AS score
    FROM held
), totals AS (
    SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_words, CAST(sum(n) FILTER (unseen) AS BIGINT) AS n_unseen,
        CAST(sum(n) FILTER (alone) AS BIGINT) AS n_alone, sum(n * score) AS log_score
    FROM scored GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_unseen, 0) AS n_unseen, coalesce(n_alone, 0) AS n_alone,
    round(coalesce(log_score, 0), 3) AS log_score
FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN totals USING (doc_id)
"""


@query("op6_stupid_backoff", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_scores(documents(spark, sf_dir)).withColumn("log_score", F.round("log_score", 3))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@query("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode(encode(documents(spark, sf_dir), PIECES), PIECES)
    return decoded.select("doc_id", "n_ids", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


@query("op1_suffix_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept", "removed")


@query("op11_nearest_neighbours")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = r"""
WITH cut AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), totals AS (
    SELECT count(*) FILTER (len(ts) > 0) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM cut
), wanted AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
), tf AS (
    SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM cut) WHERE t IN (SELECT t FROM wanted) GROUP BY ALL
), weights AS (
    SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, totals GROUP BY t, n_docs
), lengths AS (
    SELECT r, doc_id, 50 + (50 * len(ts) * n_docs) // n_terms AS m FROM cut, totals WHERE len(ts) > 0
), scored AS (
    SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
    FROM wanted JOIN tf USING (t) JOIN weights USING (t) JOIN lengths USING (r) GROUP BY ALL
), ranked AS (
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS rank
    FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


@query("op12_lexical_search", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
