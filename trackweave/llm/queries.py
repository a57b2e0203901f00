"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm.common import documents
from trackweave.llm.decontaminate import contaminated
from trackweave.llm.language_id import fit_languages, identify_languages
from trackweave.llm.minhash import minhash_components
from trackweave.llm.mixing import mix_plan
from trackweave.llm.ngram_lm import fit_kneser_ney, score_texts
from trackweave.llm.quality import fit_quality, quality_rules
from trackweave.llm.simhash import simhash_components
from trackweave.llm.spelling import spelling_variants
from trackweave.llm.token_counts import token_counts
from trackweave.llm.token_store import token_store
from trackweave.llm.toxicity import fit_toxicity, score_toxicity
from trackweave.llm.warc import round_trip
from trackweave.llm.whitening import fit_whitening, whiten

#: The tokenizer file that ids and counts are taken from.
TOKENIZER = "word_bpe_49k.json"


def fold(parts: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % parts


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = fit_toxicity(docs, labels.where(fold(5) != 0))
    return score_toxicity(docs, net).withColumn("held_out", F.coalesce(fold(5) == 0, F.lit(False)))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs, fit_quality(docs, labels))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "shard")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    trees = fit_languages(docs.where(fold(4) != 2))
    return identify_languages(docs, trees).withColumn("held_out", F.coalesce(fold(4) == 2, F.lit(False)))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_kneser_ney(docs.where(F.coalesce(fold(7) != 2, F.lit(True))))
    return score_texts(docs, model).withColumn("held_out", F.coalesce(fold(7) == 2, F.lit(False))).withColumn("train_tokens", F.lit(model.tokens).cast("long"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whiten(vectors, fit_whitening(vectors))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(documents(spark, sf_dir))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_simhash, op3_token_counts, op4_quality, op5_token_store, op6_mixing, op7_decontamination, op8_language_id, op9_warc, op10_lm_scoring, op11_whitening, op12_minhash, op13_spelling)}

ORACLE_SQL = {
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
             h AS (SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM h)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f
    """,
    "op12_minhash": r"""
        WITH RECURSIVE w AS (
                 SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
             s AS (
                 SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) <= 4 THEN [array_to_string(words, ' ')]
                        ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingle
                 FROM w),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
             l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
             e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
             r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
             c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
        SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id <= coalesce(low, doc_id) AS kept
        FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = doc_id
    """,
}
