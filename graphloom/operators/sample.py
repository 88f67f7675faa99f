"""Samplers over graphs of any size: walks in lock-step, baselines, size laws. All draws come from hashes, so they are the same on every cluster."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.enumerate import joined_shapes
from graphloom.operators.traverse import _cut, bfs_ball, khop, neighborhood_edges, neighbour_lists, seed_sample


def uniform(*parts: Column | str | int) -> Column:
    """A number from 0 to below 1 for a tuple of values: the first 32 bits of its MD5, so that other engines can draw it too."""
    text = F.concat_ws(":", *(F.lit(p) if isinstance(p, int) else F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def size_law(u: Column, low: int, high: int, power: float = 1.1) -> Column:
    """A size s from low to high with a chance in proportion to (s - low + 2) ** -power, from a uniform number."""
    weight = [(s - low + 2) ** -power for s in range(low, high + 1)]
    below = [sum(weight[: i + 1]) / sum(weight) for i in range(len(weight) - 1)]
    return (F.lit(low) + sum(((u >= x).cast("int") for x in below), F.lit(0))).cast("int")


def trials(vertices: DataFrame, n: int, low: int, high: int, seed: int = 42, law: bool = False) -> DataFrame:
    """(trial, id, size): n starts. A vertex drawn uniformly over all graphs is a graph drawn by its size and a vertex of it. Sizes are uniform, or by size_law()."""
    start = seed_sample(vertices, n, seed)
    rank = F.row_number().over(Window.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "id")), "id"))  # over n rows
    u = uniform(seed, "trial", 1)
    size = size_law(u, low, high) if law else (low + F.floor(u * (high - low + 1))).cast("int")
    return start.withColumn("trial", rank.cast("long")).withColumn("size", size).select("trial", "id", "size")


def random_trees(edges: DataFrame, starts: DataFrame, seed: int = 42, attempts: int = 3, lists: DataFrame | None = None) -> DataFrame:
    """(trial, id, step): connected sets grown from starts(trial, id, size), a vertex a step, to exactly their size.

    All trials go in lock-step: a step joins the sets with the adjacency and takes, of each trial's frontier, the entry of
    least hash. An entry is an edge out of the set, so a vertex with several of them is likelier, as in a walk that keeps its
    frontier's repeats. Trials that get stuck start again with other hashes, `attempts` times in all; those still short are left out.
    lists: neighbour_lists(), if there are some; the sets move to them.
    """
    lists, done = neighbour_lists(edges) if lists is None else lists, []
    left = _cut(starts)
    top = left.agg(F.max("size").alias("m")).first()["m"] or 0
    for attempt in range(attempts):
        sets = left.select("trial", "id", F.lit(1).alias("step"))
        for step in range(2, top + 1):
            open_ = left.where(F.col("size") >= step).select("trial")
            grown = sets.join(open_, "trial").select("trial", F.col("id").alias("at"))
            out = lists.join(grown.hint("shuffle_hash"), "at").select("trial", F.col("at").alias("id"), F.explode("to").alias("nbr"))
            out = out.join(sets.select("trial", F.col("id").alias("nbr")), ["trial", "nbr"], "left_anti")
            pick = out.groupBy("trial").agg(F.min_by("nbr", F.xxhash64("trial", "id", "nbr", F.lit(step), F.lit(seed + 1000 * attempt))).alias("id"))
            sets = _cut(sets.unionByName(pick.withColumn("step", F.lit(step))))
        full = sets.groupBy("trial").agg(F.count("*").alias("n")).join(left.select("trial", "size"), "trial").where("n = size").select("trial")
        done.append(sets.join(full, "trial", "left_semi"))
        left = _cut(left.join(full, "trial", "left_anti"))
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def radial_sets(edges: DataFrame, starts: DataFrame, radius: int = 3, lists: DataFrame | None = None) -> DataFrame:
    """(trial, id): the nearest `size` vertices within radius of each start, connected by construction; trials whose ball is smaller are left out."""
    most = starts.agg(F.max("size").alias("m")).first()["m"] or 0
    ball = bfs_ball(edges, starts.select("id").distinct(), radius, max(most, 1), lists)
    rank = F.row_number().over(Window.partitionBy("trial").orderBy("depth", "id"))
    own = starts.withColumnRenamed("id", "seed").join(ball, "seed").withColumn("r", rank).where("r <= size")
    full = own.groupBy("trial", "size").agg(F.count("*").alias("n")).where("n = size").select("trial")
    return own.join(full, "trial", "left_semi").select("trial", "id")


def baseline_queries(vertices: DataFrame, edges: DataFrame, sizes: DataFrame, kind: str = "tree", seed: int = 42, lists: DataFrame | None = None) -> DataFrame:
    """(pattern, id): for each pattern(pattern, size) a random connected set of equal size, by ball (radial) or by walk (tree): what found patterns are compared with. lists: neighbour_lists(), which both kinds can read."""
    n = sizes.count()
    start = trials(vertices, n, 1, 1, seed).select("trial", "id")
    rank = F.row_number().over(Window.orderBy("pattern"))  # one row a query pattern
    starts = _cut(start.join(sizes.withColumn("trial", rank.cast("long")), "trial"))
    got = random_trees(edges, starts.select("trial", "id", "size"), seed, lists=lists) if kind == "tree" else radial_sets(edges, starts.select("trial", "id", "size"), lists=lists)
    return got.join(starts.select("trial", "pattern"), "trial").select("pattern", "id")


def hub_starts(vertices: DataFrame, edges: DataFrame, n: int, draws: int = 10, seed: int = 42) -> DataFrame:
    """(trial, id, reach): of `draws` vertices a trial, the one that reaches most within two steps; ties to the smaller id."""
    some = _cut(trials(vertices, n * draws, 1, 1, seed).select((F.col("trial") % n).alias("trial"), "id"))
    reach = khop(edges, some.select("id").distinct(), 2).groupBy(F.col("seed").alias("id")).agg(F.count("*").alias("reach"))
    best = some.join(reach, "id").groupBy("trial").agg(F.max(F.struct("reach", (-F.col("id")).alias("low"))).alias("best"))
    return best.select("trial", (-F.col("best.low")).alias("id"), "best.reach")


def reaching(edges: DataFrame, seeds: DataFrame, n: int, depth: int) -> DataFrame:
    """The seeds that reach at least n vertices, themselves included, within depth steps: (id, reached)."""
    return khop(edges, seeds, depth).groupBy(F.col("seed").alias("id")).agg(F.count("*").alias("reached")).where(F.col("reached") >= n)


def target_subgraphs(vertices: DataFrame, edges: DataFrame, count: int = 20, most: int = 10_000, above: int = 100_000, radius: int = 12, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(graph_id, id, label) and (graph_id, src, dst, type) of targets: the graph itself, or, above so many vertices, `count` neighbourhoods of at most `most`."""
    if vertices.count() <= above:
        return vertices.select(F.lit(0).cast("long").alias("graph_id"), "id", "label"), edges.select(F.lit(0).cast("long").alias("graph_id"), "src", "dst", "type")
    ball = bfs_ball(edges, seed_sample(vertices, count, seed), radius, most)
    inner = neighborhood_edges(edges, ball)
    return ball.join(vertices.select("id", "label"), "id").select(F.col("seed").alias("graph_id"), "id", "label"), inner.withColumnRenamed("seed", "graph_id")


def sampled_motifs(vertices: DataFrame, edges: DataFrame, size: int, n: int = 1000, seed: int = 42) -> DataFrame:
    """(degrees, m, n): how often each shape comes up among n random connected sets, the baseline by sampling."""
    grown = random_trees(edges, trials(vertices, n, size, size, seed), seed)
    sets = _cut(grown.groupBy("trial").agg(F.array_sort(F.collect_list("id")).alias("nodes")))  # `size` ids
    return joined_shapes(sets, edges, size).groupBy("degrees", "m").agg(F.count("*").alias("n"))
