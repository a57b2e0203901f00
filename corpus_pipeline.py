"""A training-data pipeline over `documents`: quality, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; run() writes each stage's rows as Parquet and reads them as the next
one's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trackweave.llm.common import documents, written
from trackweave.llm.decontaminate import drop_contaminated
from trackweave.llm.mixing import mix_documents
from trackweave.llm.quality import fit_quality, keep_quality
from trackweave.llm.queries import TOKENIZER
from trackweave.llm.simhash import drop_near_duplicates
from trackweave.llm.token_store import token_store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trees reject go, null and empty texts among them.

    Each row is judged by its own text, however long, whatever its id: null and
    repeated ids stay if the text does. Without labels the base rules decide
    alone. Further columns stay; an empty table gives an empty one.
    """
    return keep_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays.

    All texts without words are one group. Of rows with equal ids and texts one
    stays, of different texts with one id each in its own group; a text without
    an id stays only where its group has none with one. Further columns stay.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with all rows of their id; those without an id stay.

    Null and empty texts hold none. Further columns stay; an empty benchmark
    takes nothing.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, row by row, whatever their ids; those without words don't come.

    Null sources are one source. Further columns stay, whatever their names.
    """
    return mix_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What reading the token files back gives for each document: doc_id, start, n_tokens, ids_crc32.

    Null ids come first, equal ids after each other; null texts have the end id alone.
    """
    return token_store(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token output", token_output)]

#: SQL can't express the trees, the fingerprints, the alignment or the coder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
