"""Search for frequent connected patterns: greedy trials, beams and tree search over a bounded set of neighbourhoods."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.canonical import canonical_code
from graphloom.operators.report import best_margin_unique, hybrid_rank, rank_patterns

FOUND = "trial bigint, size int, hash string, score double, support bigint, seed bigint, nodes array<bigint>"


@dataclass(frozen=True)
class MineSpec:
    """What to mine. The neighbourhoods are a sample of n_neighborhoods seeds; that bounds what tasks hold."""

    n_neighborhoods: int = 100
    n_trials: int = 100
    radius: int = 3
    min_size: int = 3
    max_size: int = 5
    neighborhood_size: int = 30
    top: int = 3
    beam_width: int = 4
    seed: int = 42
    rank: str = "counts"


class Agent(Protocol):
    def search(self, spark: SparkSession, store: Store, spec: MineSpec) -> DataFrame: ...


class Store:
    """The neighbourhoods as small graphs with motif vectors."""

    def __init__(self, balls: list[tuple[int, list[tuple[int, str]], list[tuple[int, int, str]]]]):
        self.graphs = []
        for seed, nodes, edges in balls:
            labels = dict(nodes)
            nbr: dict[int, set[int]] = {v: set() for v in labels}
            kinds = {}
            for a, b, t in edges:
                nbr[a].add(b)
                nbr[b].add(a)
                kinds[a, b] = t or ""
            self.graphs.append((seed, labels, nbr, kinds))
        self.vectors = np.array([self.vector(i, set(g[1])) for i, g in enumerate(self.graphs)], float).reshape(-1, 6)

    def vector(self, graph: int, nodes: set[int]) -> list[float]:
        """Counts that can't fall when a connected graph grows around its anchor: vertices, edges, wedges, triangles, largest degree, labels."""
        _, labels, nbr, _ = self.graphs[graph]
        deg = {v: len(nbr[v] & nodes) for v in nodes}
        tri = sum(len(nbr[a] & nbr[b] & nodes) for a in nodes for b in nbr[a] & nodes if a < b) / 3
        return [len(nodes), sum(deg.values()) / 2, sum(d * (d - 1) / 2 for d in deg.values()), tri, max(deg.values(), default=0), len({labels[v] for v in nodes})]

    def support(self, graph: int, nodes: set[int]) -> tuple[int, float]:
        """How many neighbourhoods may contain the pattern (violation 0), and the mean violation."""
        v = np.maximum(np.array(self.vector(graph, nodes)) - self.vectors, 0)
        e = (v * v).sum(1)
        return int((e < 1e-5).sum()), float(e.mean())

    def code(self, graph: int, nodes: set[int]) -> str:
        _, labels, _, kinds = self.graphs[graph]
        order = sorted(nodes)
        at = {v: i for i, v in enumerate(order)}
        return canonical_code(len(order), [(at[a], at[b], t) for (a, b), t in kinds.items() if a in at and b in at], [labels[v] for v in order])

    def frontier(self, graph: int, nodes: set[int]) -> list[int]:
        nbr = self.graphs[graph][2]
        return sorted({w for v in nodes for w in nbr[v]} - nodes)

    def start(self, rng: np.random.Generator) -> tuple[int, set[int]]:
        """A neighbourhood in proportion to its size, and a vertex of it."""
        size = np.array([len(g[1]) for g in self.graphs], float)
        graph = int(rng.choice(len(size), p=size / size.sum()))
        return graph, {int(rng.choice(sorted(self.graphs[graph][1])))}


def store(balls: DataFrame, inner: DataFrame, vertices: DataFrame, spec: MineSpec) -> Store:
    """Collects at most n_neighborhoods balls of at most neighborhood_size vertices."""
    v = balls.join(vertices.select("id", F.coalesce("label", F.lit("")).alias("label")), "id").groupBy("seed").agg(F.collect_list(F.struct("id", "label")).alias("v"))
    e = inner.groupBy("seed").agg(F.collect_list(F.struct("src", "dst", "type")).alias("e"))
    rows = v.join(e, "seed", "left").orderBy("seed").limit(spec.n_neighborhoods).collect()
    return Store([(r.seed, [(x.id, x.label) for x in r.v], [(x.src, x.dst, x.type) for x in r.e or []]) for r in rows])


def _trials(spark: SparkSession, n: int, run) -> DataFrame:
    def batch(it):
        import pandas as pd

        for pdf in it:
            rows = [r for t in pdf["id"] for r in run(int(t))]
            yield pd.DataFrame(rows, columns=["trial", "size", "hash", "score", "support", "seed", "nodes"])

    return spark.range(n).repartition(max(1, min(n, spark.sparkContext.defaultParallelism))).mapInPandas(batch, FOUND)


def _row(s: Store, trial: int, graph: int, nodes: set[int]) -> tuple:
    n, mean = s.support(graph, nodes)
    return trial, len(nodes), s.code(graph, nodes), mean, n, s.graphs[graph][0], sorted(nodes)


class Greedy:
    """A trial grows one set: a quarter of the steps take any neighbour, the others one of the few best-supported."""

    def search(self, spark: SparkSession, s: Store, spec: MineSpec) -> DataFrame:
        def run(trial: int) -> list[tuple]:
            rng = np.random.default_rng([spec.seed, trial])
            graph, nodes = s.start(rng)
            out = []
            while len(nodes) < spec.max_size and (around := s.frontier(graph, nodes)):
                if rng.random() < 0.25:
                    nodes = nodes | {int(rng.choice(around))}
                else:
                    scored = sorted(around, key=lambda w: (-s.support(graph, nodes | {w})[0], w))
                    nodes = nodes | {scored[int(rng.integers(min(len(scored), max(2, min(5, spec.beam_width)))))]}
                if len(nodes) >= spec.min_size:
                    out.append(_row(s, trial, graph, nodes))
            return out

        return _trials(spark, spec.n_trials, run)


class Beam:
    """A trial keeps the best beam_width sets of each size. It ends at max_size by construction."""

    def search(self, spark: SparkSession, s: Store, spec: MineSpec) -> DataFrame:
        def run(trial: int) -> list[tuple]:
            rng = np.random.default_rng([spec.seed, trial])
            graph, nodes = s.start(rng)
            beam, out = [frozenset(nodes)], []
            while beam and len(next(iter(beam))) < spec.max_size:
                grown = {b | {w} for b in beam for w in s.frontier(graph, set(b))}
                beam = sorted(grown, key=lambda b: (-s.support(graph, set(b))[0], sorted(b)))[: spec.beam_width]
                out += [_row(s, trial, graph, set(b)) for b in beam if len(b) >= spec.min_size]
            return out

        return _trials(spark, spec.n_trials, run)


class TreeSearch:
    """Upper-confidence tree search in rounds: tasks roll out from the statistics of the round before, the driver adds up visits and values of the (bounded) states."""

    def __init__(self, rounds: int = 4, explore: float = 1.4):
        self.rounds, self.explore = rounds, explore

    def search(self, spark: SparkSession, s: Store, spec: MineSpec) -> DataFrame:
        seen: dict[str, list[float]] = {}
        out = None
        per = max(1, spec.n_trials // self.rounds)
        for k in range(self.rounds):
            known, explore = {h: tuple(x) for h, x in seen.items()}, self.explore

            def run(trial: int, k=k, known=known, explore=explore) -> list[tuple]:
                rng = np.random.default_rng([spec.seed, k, trial])
                graph, nodes = s.start(rng)
                total = sum(n for n, _ in known.values()) + 1
                rows = []
                while len(nodes) < spec.max_size and (around := s.frontier(graph, nodes)):

                    def bound(w: int, nodes=nodes) -> float:
                        n, value = known.get(s.code(graph, nodes | {w}), (0, 0.0))
                        return float("inf") if not n else value / n + explore * np.sqrt(np.log(total) / n)

                    best = [w for w in around if bound(w) == max(map(bound, around))]
                    nodes = nodes | {int(rng.choice(best))}
                    if len(nodes) >= spec.min_size:
                        rows.append(_row(s, k * per + trial, graph, nodes))
                return rows

            found = _trials(spark, per, run)
            for r in found.groupBy("hash").agg(F.count("*").alias("n"), F.sum(1 - F.log(F.col("score") + 1)).alias("v")).collect():
                x = seen.setdefault(r["hash"], [0, 0.0])
                x[0] += r.n
                x[1] += r.v
            out = found if out is None else out.unionByName(found)
        return out


AGENTS = {"greedy": Greedy, "beam": Beam, "mcts": TreeSearch}


def mine(spark: SparkSession, s: Store, spec: MineSpec, agent: str = "greedy") -> DataFrame:
    """The top patterns of each size: (size, rank, key, hash, n), by counts; or by margin or hybrid as spec.rank says."""
    found = AGENTS[agent]().search(spark, s, spec)
    if spec.rank == "counts":
        return rank_patterns(found.groupBy("size", "hash").agg(F.count("*").alias("n")), spec.top)
    rows = found.select("size", "hash", F.col("seed").alias("id"), "score")
    return best_margin_unique(rows, spec.top) if spec.rank == "margin" else hybrid_rank(rows, spec.top)
