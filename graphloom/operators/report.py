"""Ranking, deduplication and summaries of discovered instances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_patterns(counts: DataFrame, top: int) -> DataFrame:
    """Of (size, hash, n): the top patterns of each size as (size, rank, key, hash, n); ties by hash."""
    w = Window.partitionBy("size").orderBy(F.desc("n"), "hash")
    r = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return r.select("size", "rank", F.format_string("size_%d_rank_%d", F.col("size").cast("int"), F.col("rank")).alias("key"), "hash", "n")


def best_margin_unique(instances: DataFrame, top: int) -> DataFrame:
    """Of (size, hash, id, score): the lowest score of each hash, then the top of each size."""
    first = Window.partitionBy("size", "hash").orderBy("score", "id")
    best = instances.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    w = Window.partitionBy("size").orderBy("score", "hash")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def hybrid_rank(instances: DataFrame, top: int) -> DataFrame:
    """By margin in sizes whose most frequent hash occurs fewer than thrice, by count in the others: (size, hash, rank)."""
    n = instances.groupBy("size", "hash").agg(F.count("*").alias("n"), F.min("score").alias("score"))
    most = n.groupBy("size").agg(F.max("n").alias("most"))
    w = Window.partitionBy("size").orderBy(F.when(F.col("most") < 3, F.col("score")).otherwise(-F.col("n")), "hash")
    return n.join(most, "size").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("size", "hash", "rank")


def instance_rates(instances: DataFrame, trials: int) -> DataFrame:
    """Of (pattern, nodes array): original and unique counts, duplicates, their rate, frequency and discovery rate."""
    g = instances.select("pattern", F.array_sort("nodes").alias("nodes")).groupBy("pattern", "nodes").agg(F.count("*").alias("k")).groupBy("pattern")
    t = g.agg(F.sum("k").alias("original_count"), F.count("*").alias("unique_count"))
    dup = F.col("original_count") - F.col("unique_count")
    return t.select("pattern", "original_count", "unique_count", dup.alias("duplicates_removed"), (dup / F.col("original_count")).alias("duplication_rate"), (F.col("original_count") / trials).alias("frequency_score"), (F.col("original_count") / F.col("unique_count")).alias("discovery_rate"))


def representative(instances: DataFrame) -> DataFrame:
    """Of (pattern, id, degrees array, n_anchors, labels array): the instance of best score, which is minus the degrees' variance + 10 an anchor + 5 a distinct label; ties to the least id."""
    d = F.transform("degrees", lambda x: x.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = total(d) / F.size("degrees")
    var = total(F.transform(d, lambda x: (x - mean) * (x - mean))) / F.size("degrees")
    score = -var + 10 * F.col("n_anchors") + 5 * F.size(F.array_distinct("labels"))
    s = instances.select("pattern", "id", F.round(score, 9).alias("score"))
    w = Window.partitionBy("pattern").orderBy(F.desc("score"), "id")
    return s.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def quartiles(counts: DataFrame, by: str, value: str) -> DataFrame:
    """Exact interpolated quartiles by group."""
    return counts.groupBy(by).agg(*(F.percentile(value, F.lit(q)).alias(c) for q, c in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))))


def spread(values: DataFrame, value: str) -> DataFrame:
    """low, high, ratio, orders of magnitude and whether a log scale is essential."""
    r = values.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    ratio = F.try_divide("high", "low")
    return r.select("low", "high", ratio.alias("ratio"), F.log10(ratio).alias("orders"), F.when(ratio > 100, "ESSENTIAL").otherwise("RECOMMENDED").alias("log_scale"))


def graph_context(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Totals of a dataset."""
    v = vertices.agg(F.count("*").alias("n_nodes"), F.countDistinct("label").alias("n_labels"))
    e = edges.agg(F.count("*").alias("n_edges"), F.countDistinct("type").alias("n_types"))
    return v.crossJoin(F.broadcast(e)).select("n_nodes", "n_edges", "n_labels", "n_types", (2 * F.col("n_edges") / F.col("n_nodes")).alias("avg_degree"))


def motif_rollup(instances: DataFrame) -> DataFrame:
    """Counts by (size, hash), by size and in total."""
    return instances.rollup("size", "hash").agg(F.count("*").alias("n"))


def open_tasks(tasks: DataFrame, done: DataFrame, known_bad: DataFrame) -> DataFrame:
    """Tasks (task_id, ...) neither done nor known to be bad: a resumed run counts each task once."""
    return tasks.join(done.select("task_id"), "task_id", "left_anti").join(known_bad.select("task_id"), "task_id", "left_anti")


def pattern_lookup(instances: DataFrame, key: str, most: int = 3) -> DataFrame:
    """A pattern's metadata with its first instances by id: rows (pattern_key, ...) of that key, `most` at most."""
    return instances.where(F.col("pattern_key") == key).orderBy("id").limit(most)


def labelled_zero(vertices: DataFrame, graph_labels: DataFrame) -> DataFrame:
    """Vertices of the graphs whose own label is 0: what a graph-labelled task mines."""
    return vertices.join(graph_labels.where("label = 0").select("graph_id"), "graph_id", "left_semi")


def log_score(chances: DataFrame) -> DataFrame:
    """(pattern, score): the sum over targets of the logarithm of the chance that a target doesn't hold the pattern, of rows (pattern, target, p_contained)."""
    return chances.groupBy("pattern").agg(F.sum(F.log(F.greatest(1 - F.col("p_contained"), F.lit(1e-12)))).alias("score"))
