"""The queries of this subpackage, one an operator, over the whole tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jpeg, lattice, mixing, partenum, quality, reshard, surrogates, token_files, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshard.shard_documents(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.store_texts(table(spark, sf_dir, "documents"))


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the mix: of the documents that ``labels`` covers, their language."""
    known = labels.where("doc_id is not null").select("doc_id").distinct()
    return docs.select("doc_id", F.col("lang").alias("domain")).join(known, "doc_id", "left_semi")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix_rates(docs, labelled_domains(docs, table(spark, sf_dir, "labels")))


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), surrogates.session_key(spark))


def op9_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_bpe, op3_lattice, op4_resharding, op5_toxicity, op6_jpeg, op7_mixing, op8_surrogates, op9_partenum, op10_token_files)}
#: What SQL can express. Of op3 the operator finds all links with a probability only, near the threshold 98 in 100.
ORACLE_SQL: dict[str, str] = {
    "op3_lattice": """
        with recursive
        usable as (
            select vec_id, cast(embedding as double[]) as e, len(embedding) as n from embeddings
            where len(embedding) > 0 and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0
        ),
        links as (select a.vec_id as u, b.vec_id as v from usable a join usable b on a.n = b.n and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.9),
        reach(u, v) as (select u, v from links union select r.u, l.v from reach r join links l on r.v = l.u),
        least as (select u, least(u, min(v)) as component_id from reach group by u),
        counts as (select u, count(*) as n_links from links group by u)
        select vec_id, coalesce(n_links, 0) as n_links, coalesce(component_id, vec_id) as component_id, coalesce(component_id, vec_id) = vec_id as kept
        from embeddings left join counts on counts.u = vec_id left join least on least.u = vec_id
    """,
    "op9_partenum": """
        with recursive
        parted as (
            select doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') if x <> ''] as w from documents
        ),
        features as (
            select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else [array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)] end) as f from parted
        ),
        sizes as (select doc_id, count(*) as n from features group by doc_id),
        met as (select a.doc_id as u, b.doc_id as v, count(*) as k from features a join features b on a.f = b.f and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
        links as (select u, v from met join sizes a on a.doc_id = u join sizes b on b.doc_id = v where 100 * k >= 75 * (a.n + b.n - k)),
        reach(u, v) as (select u, v from links union select r.u, l.v from reach r join links l on r.v = l.u),
        least as (select u, least(u, min(v)) as component_id from reach group by u)
        select p.doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, p.doc_id) as component_id
        from parted p left join sizes s on s.doc_id = p.doc_id left join least on least.u = p.doc_id
    """,
}
