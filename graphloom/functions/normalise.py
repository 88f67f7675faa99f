"""One normaliser for graphs whose vertices and edges carry free attributes: what encoders and miners read, in one select a side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalar import EDGE_TYPE_KEYS, hashed_label_id, node_label, numeric_attrs, safe_label, stable_int, weight

#: Hashed types are from 1 to this; 0 is no type.
TYPES = 1_000_000


def edge_type(attrs: Column) -> Column:
    """The first of the type keys that isn't blank or a number, else unknown."""
    named = lambda k: F.when((F.trim(attrs[k]) != "") & attrs[k].try_cast("double").isNull(), F.trim(attrs[k]))
    return F.coalesce(*(named(k) for k in EDGE_TYPE_KEYS), F.lit("unknown"))


def normal_vertices(vertices: DataFrame, anchor: Column | None = None) -> DataFrame:
    """(id, attrs, label, semantic_label, label_id, node_feature) of vertices(id, attrs map<string,string>).

    label is the attribute or else the id as text; semantic_label is what the vertex means (STRUCTURAL where nothing says so),
    label_id its hash; node_feature is 1 at the anchor (a condition) and 0 elsewhere, or 1 everywhere without one. Null attrs are as empty ones.
    """
    attrs = F.coalesce("attrs", F.create_map().cast("map<string,string>"))
    means = safe_label(node_label(attrs))
    feature = F.lit(1.0) if anchor is None else F.coalesce(anchor, F.lit(False)).cast("double")
    return vertices.select("id", attrs.alias("attrs"), F.coalesce(attrs["label"], F.col("id").cast("string")).alias("label"), means.alias("semantic_label"), hashed_label_id(means).alias("label_id"), feature.alias("node_feature"))


def normal_edges(edges: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(src, dst, attrs map<string,double>, weight, type_name, type_id) of edges(src, dst, attrs map<string,string>).

    Attributes that are neither numbers nor booleans, and those under blank keys, go; weight is 1 where there is none or no number. type_id is the attribute
    of that name if it is a number; else the vocabulary's (value, id), 0 where it lacks the type; or, without a vocabulary, a hash of the name. Null attrs are as empty ones.
    """
    attrs = F.coalesce("attrs", F.create_map().cast("map<string,string>"))
    told = edges.select("src", "dst", attrs.alias("a"), edge_type(attrs).alias("type_name"))
    given = F.col("a")["type_id"].try_cast("double").cast("long")
    if vocabulary is None:
        number = F.pmod(stable_int(F.col("type_name")), F.lit(TYPES)) + 1
    else:
        told = told.join(vocabulary.select(F.col("value").alias("type_name"), F.col("id").alias("known")), "type_name", "left")
        number = F.coalesce("known", F.lit(0).cast("long"))
    out = told.select("src", "dst", numeric_attrs(F.col("a")).alias("attrs"), weight(F.col("a")["weight"]).alias("weight"), "type_name", F.coalesce(given, number).alias("type_id"))
    return out.withColumn("attrs", F.map_concat(F.map_filter("attrs", lambda k, v: ~k.isin("weight", "type", "type_id")), F.create_map(F.lit("weight"), F.col("weight"), F.lit("type"), F.col("type_id").cast("double"), F.lit("type_id"), F.col("type_id").cast("double"))))
