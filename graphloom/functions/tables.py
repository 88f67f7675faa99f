"""Table functions: neighbourhoods of one seed and single search trials, over small graphs given as arrays."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="id bigint, depth int")
class Neighborhood:
    """neighborhood(seed, src array, dst array, radius, most): vertices of the seed's ball, nearest first, ties by id."""

    def eval(self, seed: int, src: list, dst: list, radius: int, most: int):
        near: dict = {}
        for a, b in zip(src or [], dst or [], strict=True):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        seen, layer, left = {seed}, [seed], most
        for depth in range(radius + 1):
            for v in sorted(layer)[: max(left, 0)]:
                yield v, depth
            left -= len(layer)
            layer = sorted({w for v in layer for w in near.get(v, ())} - seen)
            seen |= set(layer)
            if left <= 0 or not layer:
                return


@udtf(returnType="size int, code string, nodes array<bigint>")
class GreedyTrial:
    """greedy_trial(seed, labels array, src array, dst array, max_size): one greedy growth inside a small graph."""

    def eval(self, seed: int, labels: list, src: list, dst: list, max_size: int):
        import numpy as np

        from graphloom.operators.search import Store

        store = Store([(0, list(enumerate(labels)), [(a, b, "") for a, b in zip(src, dst, strict=True)])])
        rng = np.random.default_rng(seed)
        graph, nodes = store.start(rng)
        while len(nodes) < max_size and (around := store.frontier(graph, nodes)):
            nodes = nodes | {min(around, key=lambda w: (-store.support(graph, nodes | {w})[0], w))}
            yield len(nodes), store.code(graph, nodes), sorted(nodes)


def register_tables(spark: SparkSession) -> None:
    spark.udtf.register("neighborhood", Neighborhood)
    spark.udtf.register("greedy_trial", GreedyTrial)
