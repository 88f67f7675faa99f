"""Vocabularies of labels and edge types: ids from 1 in sorted order, 0 for unknown."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ranks import running

UNK = "UNK"
VERSION = "v1"


def build(values: DataFrame, column: str) -> DataFrame:
    """(value, id) of the distinct non-null values, numbered from 1 in their order by ranges."""
    v = values.select(F.col(column).alias("value")).where(F.col("value").isNotNull() & (F.col("value") != UNK)).distinct()
    return running(v, [F.col("value")], {"id": F.lit(1)})


def encode(df: DataFrame, column: str, vocabulary: DataFrame, out: str) -> DataFrame:
    """df with out: the value's id, 0 where it is null or unknown. Spark broadcasts the vocabulary if it finds it small."""
    v = vocabulary.select(F.col("value").alias(column), F.col("id").alias(out))
    return df.join(v, column, "left").withColumn(out, F.coalesce(out, F.lit(0).cast("long")))


def to_json(nodes: DataFrame, types: DataFrame) -> dict[str, str]:
    """The three vocabulary files as texts: node labels, edge types, metadata."""
    n, t = ({UNK: 0} | {r.value: r.id for r in df.orderBy("id").collect()} for df in (nodes, types))
    meta = {"vocab_version": VERSION, "num_node_labels": len(n), "num_edge_types": len(t)}
    return {"node_labels.json": json.dumps(n, ensure_ascii=False), "edge_types.json": json.dumps(t, ensure_ascii=False), "metadata.json": json.dumps(meta)}


def check(metadata: dict | None, required: bool = False) -> bool:
    """Whether a vocabulary was found; raises if it is required and missing, or of another version."""
    if metadata is None:
        if required:
            raise FileNotFoundError("a vocabulary is required")
        return False
    if metadata.get("vocab_version") != VERSION:
        raise ValueError(f"vocabulary version {metadata.get('vocab_version')}, not {VERSION}")
    return True
