"""Labels and edge types for graphs that have none, by degree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalar import pair_hash
from graphloom.models.training import PRESETS
from graphloom.operators.features import degree_buckets
from graphloom.operators.sample import uniform


def weighted_label(u: Column, weights: tuple[tuple[str, float], ...]) -> Column:
    """The label that a uniform number falls on."""
    total, upto, out = sum(w for _, w in weights), 0.0, None
    for label, w in weights[:-1]:
        upto += w
        out = (F if out is None else out).when(u < upto / total, F.lit(label))
    return F.lit(weights[-1][0]) if out is None else out.otherwise(F.lit(weights[-1][0]))


def annotate(vertices: DataFrame, edges: DataFrame, preset: str = "biology", noise: float = 0.0, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(id, label) and (src, dst, type, type_id): labels drawn by degree bucket with the preset's weights, `noise` of them null; edge types by a hash of both labels.

    An edge with an unlabelled end is `unknown`, number 0. A noisy edge takes any type of the preset and, as in the
    usual generator, keeps the number of the type it would have had. Vertices without edges count as low.
    """
    spec = PRESETS[preset]
    bucket = vertices.select("id").join(degree_buckets(edges).select("id", "bucket"), "id", "left")
    u = uniform(seed, "id", 1)
    label = F.when(F.col("bucket") == "high", weighted_label(u, spec["high"])).when(F.col("bucket") == "mid", weighted_label(u, spec["mid"])).otherwise(weighted_label(u, spec["low"]))
    v = bucket.select("id", F.when(uniform(seed, "id", 2) >= noise, label).alias("label"))
    types = F.array(*map(F.lit, spec["types"]))
    e = edges.select("src", "dst").join(v.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(v.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    place = F.when(F.col("a").isNull() | F.col("b").isNull(), 0).otherwise(pair_hash(F.col("a"), F.col("b")) % len(spec["types"]) + 1).cast("int")
    any_type = (F.floor(uniform(seed, "src", "dst", 4) * len(spec["types"])) + 1).cast("int")
    kind = F.when(F.col("type_id") == 0, "unknown").when(uniform(seed, "src", "dst", 3) < noise, F.element_at(types, any_type)).otherwise(F.try_element_at(types, F.greatest("type_id", F.lit(1))))
    return v, e.withColumn("type_id", place).select("src", "dst", kind.alias("type"), "type_id")
