"""A training-data pipeline over documents: quality, near duplicates, secrets, mixture, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import minhash, mixing, pieces, quality, secrets
from graphloom.llm.common import stage

#: How the mixing stage changes the domains' shares: toxic ones to a quarter. Targets below what clean texts hold of toxic domains by doubt alone can only be met by dropping clean texts.
TILT = {"q1t0": 1.0, "q0t0": 1.0, "q1t1": 0.25, "q0t1": 0.25}
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the quality classifier accepts, each judged by itself: null doc_ids and repeated rows too. Null and empty texts share one score."""
    net = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs.select(*COLUMNS), net)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one of least doc_id. Rows with a null doc_id stay, as they can't be told apart by it; so do repeated rows of a kept document. Null and empty texts are one class."""
    dropped = minhash.near_duplicates(docs).where("doc_id is not null and not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each found secret replaced by [SECRET], n_chars counted anew."""
    return secrets.redact(docs).select(*COLUMNS[:-1], F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mixture asks, which leaves toxic domains a quarter of their share; copies of one document are equal rows. Null doc_ids are rows like others; empty texts have no tokens and the rate of their probabilities."""
    return mixing.mix_rows(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"), tilt=TILT)


def in_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces and lossless of each row, in pieces drawn by doc_id."""
    return pieces.encode(docs)


STAGES = [("quality", keep_quality), ("near_duplicates", keep_first_copies), ("secrets", hide_secrets), ("mixing", mixed), ("sentencepiece", in_pieces)]

#: No stage but the third can be told in SQL: a fitted network, sampled signatures, fitted rates and sampled pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each written as Parquet into the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
