"""From documents to training tokens: each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lazyframe.llm import bpe, mixing, partenum, surrogates, toxicity
from lazyframe.llm.common import fresh
from lazyframe.llm.queries import labelled_domains, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar shingle sets."""
    return partenum.one_of_each(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with surrogates in their texts."""
    return surrogates.with_surrogates(docs, surrogates.session_key(spark)).drop("n_entities")


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of languages asks for; the temperature targets shrink no language, and each document stays once at least."""
    return mixing.mixed_documents(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), keep_all=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the hashes of ids and decoded bytes, of every row."""
    return bpe.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("surrogates", replace_personal_data),
    ("mixing", mix_languages),
    ("bpe", encode),
]
#: SQL can't express these stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        at = fresh(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
