"""Training data, and the threshold classifier on order violations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.allpairs import MOMENTS, REACH, moments, total

#: Labels by degree bucket with their weights, and edge types.
PRESETS = {
    "biology": {"high": (("TF", 0.60), ("Gene", 0.25), ("Enzyme", 0.15)), "mid": (("Gene", 0.45), ("mRNA", 0.35), ("Enzyme", 0.20)), "low": (("Metabolite", 0.60), ("mRNA", 0.25), ("Gene", 0.15)), "types": ("regulates", "transcribes", "translates", "catalyzes")},
    "ecommerce": {"high": (("product", 0.55), ("category", 0.30), ("brand", 0.15)), "mid": (("customer", 0.45), ("product", 0.35), ("brand", 0.20)), "low": (("review", 0.60), ("customer", 0.25), ("brand", 0.15)), "types": ("viewed", "purchased", "belongs_to", "made_by", "wrote")},
    "social": {"high": (("influencer", 0.60), ("community", 0.25), ("user", 0.15)), "mid": (("user", 0.55), ("creator", 0.25), ("community", 0.20)), "low": (("new_user", 0.60), ("bot", 0.25), ("user", 0.15)), "types": ("follows", "mentions", "replies_to", "belongs_to")},
    "universal": {
        "high": (("Hub Entity", 0.18), ("Gene", 0.12), ("User", 0.12), ("Product", 0.12), ("Organization", 0.10), ("Protein", 0.10), ("Category", 0.09), ("Compound", 0.09), ("Topic", 0.08)),
        "mid": (("Entity", 0.16), ("Document", 0.12), ("Disease", 0.10), ("Book", 0.10), ("Music", 0.08), ("Pathway", 0.08), ("Customer", 0.08), ("Creator", 0.08), ("Anatomy", 0.07), ("Location", 0.07), ("Event", 0.06)),
        "low": (("Leaf Entity", 0.16), ("Review", 0.12), ("Side Effect", 0.10), ("Symptom", 0.10), ("Metabolite", 0.09), ("Tag", 0.09), ("Comment", 0.08), ("Image", 0.07), ("Article", 0.07), ("Video", 0.06), ("Record", 0.06)),
        "types": tuple(f"relation_{i:02d}" for i in range(1, 64)),
    },
}


def _connect(n: int, edges: set[tuple[int, int]], rng: np.random.Generator) -> set[tuple[int, int]]:
    """Adds an edge from each later component to the first."""
    label = list(range(n))

    def find(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in edges:
        label[find(a)] = find(b)
    for v in range(1, n):
        if find(v) != find(0):
            w = int(rng.integers(v))
            while find(w) != find(0):
                w = 0
            edges.add((min(v, w), max(v, w)))
            label[find(v)] = find(0)
    return edges


def random_graph(kind: str, n: int, rng: np.random.Generator) -> set[tuple[int, int]]:
    """A connected graph: er (density of a beta law), ws (ring, rewired), ba (preferential), plc (preferential with triangles)."""
    e: set[tuple[int, int]] = set()
    add = lambda a, b: e.add((min(a, b), max(a, b))) if a != b else None
    if kind == "er":
        p = float(rng.beta(1.3, 1.3 * n / np.log2(max(n, 2)) - 1.3)) if n > 4 else 0.5
        a, b = np.triu_indices(n, 1)
        for i in np.flatnonzero(rng.random(len(a)) < p):
            add(int(a[i]), int(b[i]))
    elif kind == "ws":
        k, beta = max(2, int(np.log2(n))), float(rng.beta(2, 2))
        for v in range(n):
            for j in range(1, k // 2 + 1):
                add(v, int(rng.integers(n)) if rng.random() < beta else (v + j) % n)
    else:
        m = max(1, int(np.log2(n)) // 2)
        ends = list(range(min(n, m + 1)))
        for v in range(1, min(n, m + 1)):
            add(v - 1, v)
        for v in range(m + 1, n):
            chosen: set[int] = set()
            while len(chosen) < m:
                w = int(rng.choice(ends))
                if kind == "plc" and chosen and rng.random() < 0.3:
                    near = [x for a, b in e for x in ((b,) if a in chosen else (a,) if b in chosen else ())]
                    w = int(rng.choice(near)) if near else w
                if w != v:
                    chosen.add(w)
            for w in chosen:
                add(v, w)
                ends += [v, w]
    return _connect(n, e, rng)


KINDS = ("er", "ws", "ba", "plc")


def synthetic_graphs(spark: SparkSession, n: int, size: tuple[int, int] = (10, 30), seed: int = 42, planted: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """(graph_id, kind, n, edges array<struct<src,dst>>): each graph from its own id and the seed alone, of a size drawn from `size`, or as sizes(graph_id, n) say, of which there is a twin each. planted: a fixed pattern of ten vertices is added to each by two bridges."""
    plant = sorted(random_graph("er", 10, np.random.default_rng(14853)))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for g, given in zip(pdf["graph_id"], pdf["n"], strict=True):
                rng = np.random.default_rng([seed, int(g)])
                kind, k = KINDS[int(rng.integers(4))], int(rng.integers(size[0], size[1] + 1))
                k = k if given < 0 else max(int(given), 2)
                e = random_graph(kind, k, rng)
                if planted:
                    e = e | {(a + k, b + k) for a, b in plant} | {(int(rng.integers(k)), k + int(rng.integers(10))) for _ in range(2)}
                rows.append((g, kind, k + 10 * planted, [{"src": a, "dst": b} for a, b in sorted(e)]))
            yield pd.DataFrame(rows, columns=["graph_id", "kind", "n", "edges"])

    of = spark.range(n).select(F.col("id").alias("graph_id"), F.lit(-1).alias("n")) if sizes is None else sizes.select(F.col("graph_id").cast("bigint").alias("graph_id"), F.col("n").cast("int").alias("n"))
    return of.mapInPandas(run, "graph_id bigint, kind string, n int, edges array<struct<src:bigint,dst:bigint>>")


def _grow(nbr: dict[int, set[int]], start: int, k: int, rng: np.random.Generator) -> set[int]:
    have, around = {start}, set(nbr[start])
    while len(have) < k and around:
        v = int(rng.choice(sorted(around)))
        have.add(v)
        around = (around | nbr[v]) - have
    return have


#: Labels of generated graphs that come without any.
N_LABELS = 4
NEGATIVES = ("label", "hard", "structure")


@dataclass
class Labelled:
    """A small graph: labels by vertex, edges, and the vertex that it is anchored at."""

    labels: dict[int, int]
    edges: list[tuple[int, int]]
    anchor: int


def _linked(vertices: set[int], edges: list[tuple[int, int]]) -> bool:
    nbr: dict[int, set[int]] = {v: set() for v in vertices}
    for x, y in edges:
        nbr[x].add(y)
        nbr[y].add(x)
    return len(_grow(nbr, min(vertices), len(vertices), np.random.default_rng(0))) == len(vertices)


def _moved_labels(b: Labelled, rng: np.random.Generator) -> Labelled:
    """The same labels on other vertices."""
    ids = list(b.labels)
    values = [b.labels[v] for v in ids]
    mixed = [values[i] for i in rng.permutation(len(ids))]
    mixed = mixed[1:] + mixed[:1] if mixed == values else mixed
    return Labelled(dict(zip(ids, mixed, strict=True)), b.edges, b.anchor)


def _near_miss(b: Labelled, rng: np.random.Generator) -> Labelled | None:
    """One edge more, or one edge moved to another place, still connected."""
    ids, have = sorted(b.labels), set(b.edges)
    free = [(x, y) for i, x in enumerate(ids) for y in ids[i + 1 :] if (x, y) not in have]
    if not free:
        return None
    edges = [*b.edges, free[int(rng.integers(len(free)))]]
    if rng.random() < 0.8:
        edges.pop(int(rng.integers(len(b.edges))))
    return Labelled(b.labels, sorted(edges), b.anchor) if _linked(set(ids), edges) else None


def labelled_pair(n: int, edges: list[tuple[int, int]], kind: str, rng: np.random.Generator, labels: list[int] | None = None, tries: int = 8) -> tuple[Labelled, Labelled] | None:
    """(a, b): a is a connected sample of the graph, b a connected sample of a with its anchor (positive), or a near miss of the same law of sizes that an exact search doesn't find in a.

    label: b's labels on other vertices. hard: an edge of b added or moved. structure: a connected sample from elsewhere in
    the graph. drawn: such a sample, contained or not. None where no try gives a negative.
    """
    nbr: dict[int, set[int]] = {v: set() for v in range(n)}
    for x, y in edges:
        nbr[x].add(y)
        nbr[y].add(x)
    named = dict(enumerate(labels if labels is not None else rng.integers(N_LABELS, size=n).tolist()))

    def part(of: dict[int, set[int]], start: int, size: int, anchor: int | None = None) -> Labelled:
        have = _grow(of, start, size, rng)
        at = anchor if anchor in have else int(rng.choice(sorted(have)))
        return Labelled({v: named[v] for v in sorted(have)}, [(x, y) for x in sorted(have) for y in sorted(of[x] & have) if x < y], at)

    for _ in range(tries):
        a = part(nbr, int(rng.integers(n)), max(4, int(rng.integers(n // 2, max(n // 2 + 1, 3 * n // 4)))))
        big = set(a.labels)
        inner = {v: nbr[v] & big for v in big}
        size = int(rng.integers(3, max(4, 2 * len(big) // 3 + 1)))
        b = part(inner, int(rng.choice(sorted(big))), size)
        a.anchor = b.anchor
        if kind == "positive":
            return a, b
        if kind in ("structure", "drawn"):
            away = sorted(set(range(n)) - big) or list(range(n))
            b = part(nbr, int(rng.choice(away)), size)
            a.anchor = b.anchor if b.anchor in big else a.anchor
        else:
            b = _moved_labels(b, rng) if kind == "label" else _near_miss(b, rng)
        if b is not None and (kind == "drawn" or not contains(a.labels, a.edges, b.labels, b.edges)):
            return a, b
    return None


def pair_batches(graphs: DataFrame, seed: int = 42, label_negatives: float = 0.25, hard_negatives: float = 0.25, balanced: bool = True) -> DataFrame:
    """(pair_id, label, kind, a, b, a_labels, b_labels, a_anchor, b_anchor): edge lists, labels by vertex and anchors, where b lies (label 1) in a, anchor on anchor, or doesn't (0).

    graphs(graph_id, n, edges[, labels array<int>]). balanced: half of the pairs, by draws, are negatives of a stated kind, verified; a graph that gives none of its kind gives one of another, and one
    that gives none at all (a clique of one label) no pair. Else the imbalanced source: b is drawn apart from a, and the label is what an exact test of anchored containment says.
    """
    given = "labels" in graphs.columns

    def run(batches):
        import pandas as pd

        as_rows = lambda e: [{"src": int(x), "dst": int(y)} for x, y in e]
        for pdf in batches:
            rows = []
            for g, n, edges, labels in zip(pdf.graph_id, pdf.n, pdf.edges, pdf.labels if given else [None] * len(pdf), strict=True):
                rng = np.random.default_rng([seed, int(g), 1])
                pairs = [(int(x["src"]), int(x["dst"])) for x in edges]
                u, kinds = rng.random(), ["positive"]
                if balanced and rng.random() < 0.5:
                    kind = "label" if u < label_negatives else "hard" if u < label_negatives + hard_negatives else "structure"
                    kinds = [kind, *(k for k in NEGATIVES if k != kind)]
                elif not balanced:
                    kinds = ["drawn"]
                for kind in kinds:
                    made = labelled_pair(int(n), pairs, kind, rng, None if labels is None else [int(x) for x in labels])
                    if made:
                        a, b = made
                        label = int(contains(a.labels, a.edges, b.labels, b.edges, (a.anchor, b.anchor))) if kind == "drawn" else int(kind == "positive")
                        rows.append((g, label, kind, as_rows(a.edges), as_rows(b.edges), a.labels, b.labels, a.anchor, b.anchor))
                        break
            yield pd.DataFrame(rows, columns=["pair_id", "label", "kind", "a", "b", "a_labels", "b_labels", "a_anchor", "b_anchor"])

    e, m = "array<struct<src:bigint,dst:bigint>>", "map<bigint,int>"
    return graphs.select("graph_id", "n", "edges", *(["labels"] if given else [])).mapInPandas(run, f"pair_id bigint, label int, kind string, a {e}, b {e}, a_labels {m}, b_labels {m}, a_anchor bigint, b_anchor bigint")


def contains(a_labels: dict[int, int], a: list, b_labels: dict[int, int], b: list, anchors: tuple[int, int] | None = None) -> bool:
    """Whether b is a subgraph of a, labels kept, edges of b among a's, and b's anchor on a's where anchors (of a, of b) are given: an exact search for small graphs."""
    near: dict[int, set[int]] = {v: set() for v in a_labels}
    for x, y in a:
        near[x].add(y)
        near[y].add(x)
    want: dict[int, set[int]] = {v: set() for v in b_labels}
    for x, y in b:
        want[x].add(y)
        want[y].add(x)
    order: list[int] = []
    while len(order) < len(want):  # each next one next to an earlier one, where it can be
        rest = [v for v in want if v not in order]
        order.append(max(rest, key=lambda v: (len(want[v] & set(order)), len(want[v]))))
    to: dict[int, int] = {}

    def place(i: int) -> bool:
        if i == len(order):
            return True
        v = order[i]
        done = [to[x] for x in want[v] if x in to]
        some = set.intersection(*(near[x] for x in done)) if done else set(near)
        for w in sorted(some - set(to.values())):
            if a_labels[w] == b_labels[v] and len(near[w]) >= len(want[v]) and (anchors is None or (w == anchors[0]) == (v == anchors[1])):
                to[v] = w
                if place(i + 1):
                    return True
                del to[v]
        return False

    return place(0)


def pairs_from_graph(vertices: DataFrame, edges: DataFrame, n: int, size: int = 20, seed: int = 42, seeds: DataFrame | None = None) -> DataFrame:
    """The single-graph source: n neighbourhoods of one large graph as (graph_id, n, edges, labels), with places for ids, as pair_batches() takes them. labels come from vertices.label_id, or else from a hash of label. seeds (id): where they start, n drawn ones by default."""
    from pyspark.sql import Window

    from graphloom.operators.traverse import bfs_ball, neighborhood_edges, seed_sample

    ball = bfs_ball(edges, seed_sample(vertices, n, seed) if seeds is None else seeds, 3, size)
    place = ball.withColumn("at", (F.row_number().over(Window.partitionBy("seed").orderBy("depth", "id")) - 1).cast("long"))
    e = neighborhood_edges(edges, ball).join(place.select("seed", F.col("id").alias("src"), F.col("at").alias("x")), ["seed", "src"]).join(place.select("seed", F.col("id").alias("dst"), F.col("at").alias("y")), ["seed", "dst"])
    graphs = e.groupBy("seed").agg(F.array_sort(F.collect_set(F.struct(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")))).alias("edges"))  # a neighbourhood's edges
    many = place.groupBy("seed").agg(F.count("*").cast("int").alias("n")).where("n > 3")
    number = F.col("label_id").cast("int") if "label_id" in vertices.columns else F.pmod(F.xxhash64("label"), F.lit(1 << 16)).cast("int")
    named = place.join(vertices.select("id", number.alias("l")), "id").groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("at", "l"))).alias("v"))  # `size` vertices
    return graphs.join(many, "seed").join(named, "seed").select(F.col("seed").alias("graph_id"), "n", "edges", F.col("v.l").alias("labels"))


def source(name: str, spark: SparkSession, n: int, seed: int = 42, vertices: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """Labelled pairs by the tokens of a source's name: syn or a single graph (node, with vertices and edges), balanced or imbalanced."""
    tokens = set(name.split("-"))
    if "node" in tokens or edges is not None:
        graphs = pairs_from_graph(vertices, edges, n, seed=seed)
    elif "syn" in tokens:
        graphs = synthetic_graphs(spark, n, seed=seed)
    else:
        raise ValueError(f"no source is called {name}")
    return pair_batches(graphs, seed, balanced="imbalanced" not in tokens)


def batch_mix(size: int, label_ratio: float, hard_ratio: float) -> dict[str, int]:
    """Half positives; of the negatives a share by label, a share hard, the rest structural."""
    negative = size - size // 2
    by_label = round(negative * label_ratio)
    hard = round((negative - by_label) * hard_ratio)
    return {"positive": size // 2, "label": by_label, "hard": hard, "structure": negative - by_label - hard}


def mix_weights(weights: list[str] | None, presets: list[str]) -> list[float]:
    """Weights of presets that sum to one; equal ones where they can't be read, don't fit or sum to nothing."""
    try:
        w = [float(x) for x in weights or []]
    except ValueError:
        w = []
    return [x / sum(w) for x in w] if len(w) == len(presets) and sum(w) > 0 else [1 / len(presets)] * len(presets)


def fit_threshold(pairs: DataFrame, rounds: int = 25) -> tuple[float, float]:
    """Weight and bias of the logistic classifier P(contained) = sigmoid(w e + b) on violations e: Newton steps, each one aggregate to five sums."""
    w = b = 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.col("violation") * w + b)))
        g, h, e = F.col("label") - p, p * (1 - p), F.col("violation")
        r = pairs.agg(F.sum(g * e).alias("gw"), F.sum(g).alias("gb"), F.sum(h * e * e).alias("hww"), F.sum(h * e).alias("hwb"), F.sum(h).alias("hbb")).first()
        if r["gb"] is None:
            return 0.0, 0.0
        step = np.linalg.solve([[r["hww"] + 1e-6, r["hwb"]], [r["hwb"], r["hbb"] + 1e-6]], [r["gw"] - 1e-6 * w, r["gb"] - 1e-6 * b])
        w, b = w + float(step[0]), b + float(step[1])
        if abs(step).max() < 1e-8:
            break
    return w, b


def _sigmoid_slopes(u: np.ndarray, order: int) -> list[np.ndarray]:
    """The logistic curve and its derivatives up to an order, each a polynomial of the curve itself."""
    s, out, poly = 1 / (1 + np.exp(-u)), [], np.polynomial.Polynomial([0.0, 1.0])
    for _ in range(order + 1):
        out.append(poly(s))
        poly = poly.deriv() * np.polynomial.Polynomial([0.0, 1.0, -1.0])
    return out


def _newton_sums(label, middle, half, m, w, b, order=MOMENTS - 3):
    """The five sums of a Newton step from moments m (bins, MOMENTS) of bins: the curve's series around each bin's middle, term by term."""
    slopes = _sigmoid_slopes(w * middle + b, order + 1)
    step, fact = w * half, 1.0
    gb, gw = label * m[:, 0], label * (middle * m[:, 0] + half * m[:, 1])
    hbb, hwb, hww = np.zeros(len(m)), np.zeros(len(m)), np.zeros(len(m))
    for k in range(order + 1):
        fact *= max(k, 1)
        a = step**k / fact
        one, e, ee = m[:, k], middle * m[:, k] + half * m[:, k + 1], middle**2 * m[:, k] + 2 * middle * half * m[:, k + 1] + half**2 * m[:, k + 2]
        gb, gw = gb - slopes[k] * a * one, gw - slopes[k] * a * e
        hbb, hwb, hww = hbb + slopes[k + 1] * a * one, hwb + slopes[k + 1] * a * e, hww + slopes[k + 1] * a * ee
    return {k: float(x.sum()) for k, x in (("gw", gw), ("gb", gb), ("hww", hww), ("hwb", hwb), ("hbb", hbb))}


def fit_threshold_of(patterns: DataFrame, targets: DataFrame, rounds: int = 25, bins: int = 4_096) -> tuple[float, float]:
    """fit_threshold() on all pairs of frames (id, v, label), whose label is whether labels agree: pairs are met once.

    Moments of the violations in bins of one width stand for them: a table of at most two rows a bin, whatever the input. Inside a bin the logistic curve is its series, whose
    rest is below 1e-12 of it while a bin reaches no farther than REACH on the curve's scale; a steeper curve is fitted on the pairs themselves, met again each round.
    """

    def ends(side, which):
        x = side.where("v is not null").select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(which("x").alias("x"))
        return {r["at"]: r["x"] for r in x.collect()}  # a row an entry

    least, most = ends(targets, F.min), ends(patterns, F.max)
    top = sum(max(x - least[at], 0.0) ** 2 for at, x in most.items() if x is not None and least.get(at) is not None) * (1 + 1e-9) + 1e-12
    rows, half = None, top / bins / 2
    if np.isfinite(top):
        t = moments(patterns, targets, top / bins, bins).collect()
        if not t:
            return 0.0, 0.0
        label, middle = np.array([r["label"] for r in t], float), (np.array([r["bin"] for r in t]) + 0.5) * 2 * half
        rows = np.array([[r[f"m{j}"] for j in range(MOMENTS)] for r in t])

    w = b = 0.0
    for _ in range(rounds):
        if rows is not None and abs(w) * half <= REACH:
            r = _newton_sums(label, middle, half, rows, w, b)
        else:

            def terms(e, same, w=w, b=b):
                p = 1 / (1 + np.exp(-(e * w + b)))
                g, h = same - p, p * (1 - p)
                return [g * e, g, h * e * e, h * e, h]

            r = total(patterns, targets, terms, ["gw", "gb", "hww", "hwb", "hbb"]).first()
            if r["gb"] is None:
                return 0.0, 0.0
        step = np.linalg.solve([[r["hww"] + 1e-6, r["hwb"]], [r["hwb"], r["hbb"] + 1e-6]], [r["gw"] - 1e-6 * w, r["gb"] - 1e-6 * b])
        w, b = w + float(step[0]), b + float(step[1])
        if abs(step).max() < 1e-8:
            break
    return w, b
