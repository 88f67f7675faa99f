"""The queries of this subpackage, by name, and their SQL where it can be told."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from graphloom.llm import bm25, centroids, collisions, minhash, mixing, pieces, pii, quality, secrets, spelling, suffix, toxicity, url_filter
from graphloom.llm.digests import span_digest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table of the given folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each whole text of documents: base counts and digest, all spans."""
    return span_digest(secrets.scan_secrets(table(spark, sf_dir, "documents")), secrets.BASE)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each whole text of documents: base counts and digest, all spans."""
    return span_digest(pii.find_pii(table(spark, sf_dir, "documents")), pii.KINDS)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for each url of pages."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for each whole text of documents."""
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pieces of each whole text of documents."""
    return pieces.encode(table(spark, sf_dir, "documents"))


def op4_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for each document whose id is divisible by 20."""
    docs = table(spark, sf_dir, "documents")
    return bm25.search(docs, docs.where("doc_id % 20 = 0"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate for each document, so that domains meet their target shares."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates of each document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of each vector of embeddings."""
    return collisions.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each whole text of documents without repeated strings."""
    return suffix.drop_repeats(table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for each whole text of documents, and how many terms were found, in all and within quotation marks."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.find_terms(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))).drop("hits")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of documents with its more frequent form and where forms lead."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of each vector of embeddings."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_secret_scan": op1_secret_scan, "op2_url_filter": op2_url_filter, "op3_sentencepiece": op3_sentencepiece, "op4_bm25": op4_bm25, "op5_mixing": op5_mixing, "op6_minhash": op6_minhash, "op7_pii": op7_pii, "op8_quality": op8_quality, "op9_suffix": op9_suffix, "op10_collisions": op10_collisions, "op11_toxicity": op11_toxicity, "op12_spelling": op12_spelling, "op13_centroids": op13_centroids, "pipeline": corpus_pipeline.run}
ORACLE_SQL: dict[str, str] = {"op2_url_filter": url_filter.SQL, "op10_collisions": collisions.SQL, "op12_spelling": spelling.SQL, "op13_centroids": centroids.SQL}
