import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.models import learn as L
from graphloom.models import training as G
from graphloom.models.annotate import annotate
from graphloom.models.encoder import EncoderSpec, embed, text_vectors
from graphloom.operators import canon as C
from graphloom.operators import features as X
from graphloom.operators import report as R
from graphloom.operators import sample as P
from graphloom.operators import traverse as T
from graphloom.operators.enumerate import connected_sets, motif_counts
from graphloom.sinks import writers as W
from graphloom.sources import readers as D


@pytest.fixture(scope="module")
def graph(spark):
    rng = np.random.default_rng(3)
    e = sorted(G.random_graph("ba", 60, rng)) + [(100, 101), (101, 102)]
    v = sorted({x for p in e for x in p})
    return spark.createDataFrame([(x, f"L{x % 3}") for x in v], "id long, label string"), spark.createDataFrame([(a, b, None) for a, b in e], "src long, dst long, type string"), e


def connected(nodes, edges):
    nodes, seen = set(nodes), set()
    todo = [min(nodes)]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [b if a == x else a for a, b in edges if x in (a, b) and {a, b} <= nodes]
    return seen == nodes


def test_trees_are_connected_and_of_their_size(spark, graph):
    v, e, edges = graph
    starts = P.trials(v, 20, 3, 6)
    size = {r.trial: r["size"] for r in starts.collect()}
    assert set(size.values()) <= {3, 4, 5, 6} and len(size) == 20
    got = {}
    for r in P.random_trees(e, starts).collect():
        got.setdefault(r.trial, []).append(r.id)
    assert got and all(len(set(x)) == size[t] and connected(x, edges) for t, x in got.items())
    assert all(set(x) <= {100, 101, 102} or not set(x) & {100, 101, 102} for x in got.values())
    sizes = spark.createDataFrame([(7, 4), (8, 5)], "pattern int, size int")
    for kind in ("tree", "radial"):
        sets = {}
        for r in P.baseline_queries(v, e, sizes, kind).collect():
            sets.setdefault(r.pattern, set()).add(r.id)
        assert all(len(x) == {7: 4, 8: 5}[k] and connected(x, edges) for k, x in sets.items())
    assert sum(r.n for r in P.sampled_motifs(v, e, 3, 30).collect()) > 20


def test_reach_and_hubs(spark, graph):
    v, e, edges = graph
    ids = v.select("id")
    far = {r.id for r in P.reaching(e, ids, 4, 3).collect()}
    assert not far & {100, 101, 102} and len(far) == 60
    assert P.hub_starts(v, e, 3).count() == 3
    targets, inner = P.target_subgraphs(v, e, 4, 20, above=10)
    assert targets.groupBy("graph_id").count().agg(F.max("count")).first()[0] <= 20 and inner.count() > 0
    assert P.target_subgraphs(v, e)[0].count() == v.count()


def test_balls_are_capped_by_layer(graph):
    _, e, _ = graph
    seeds = T.adjacency(e).select("id").distinct()
    whole = {}
    for r in T.khop(e, seeds, 3).collect():
        whole.setdefault(r.seed, []).append((r.depth, r.id))
    capped = {}
    for r in T.bfs_ball(e, seeds, 3, 9).collect():
        capped.setdefault(r.seed, []).append((r.depth, r.id))
    assert {k: sorted(x) for k, x in capped.items()} == {k: sorted(x)[:9] for k, x in whole.items()}


def test_components_of_paths_and_stars(spark):
    e = [(i, i + 1) for i in range(50)] + [(200, 200 + i) for i in range(1, 40)] + [(400, 400)]
    v = sorted({x for p in e for x in p} | {999})
    got = {r.id: r.component for r in T.components(spark.createDataFrame([(x,) for x in v], "id long"), spark.createDataFrame(e, "src long, dst long")).collect()}
    assert got == {x: 0 if x <= 50 else 200 if x < 300 else x for x in v}


def test_exact_sets_of_four(spark):
    k4 = spark.createDataFrame([(a, b) for a in range(4) for b in range(a)] + [(10 + a, 10 + (a + 1) % 4) for a in range(4)] + [(20, 21), (20, 22), (20, 23)], "src long, dst long")
    assert {(r.degrees, r.m, r.n) for r in motif_counts(k4, 4).collect()} == {("3,3,3,3", 6, 1), ("2,2,2,2", 4, 1), ("1,1,1,3", 3, 1)}
    assert connected_sets(k4, 4).count() == 3


def test_closed_walks(spark):
    e = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 0, 2), (2, 5, 6)], "graph_id long, src long, dst long")
    v = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 5), (2, 6), (2, 7)], "graph_id long, id long")
    got = {r.id: r.powers for r in X.identity_powers(e, v, 3).collect()}
    assert np.allclose(got[0], [0, 0.5, 0.25]) and np.allclose(got[5], [0, 1, 0]) and np.allclose(got[7], [0, 0, 0])
    pairs = [(int(a), int(b)) for a, b in np.random.default_rng(2).integers(0, 9, (16, 2)) if a < b]
    m = np.zeros((9, 9))
    for a, b in pairs:
        m[a, b] = m[b, a] = 1
    d = np.where(m.sum(1) > 0, m.sum(1), 1) ** -0.5
    m = d[:, None] * m * d
    rows = X.identity_powers(spark.createDataFrame([(3, a, b) for a, b in pairs], "graph_id long, src long, dst long"), spark.range(9).selectExpr("3L graph_id", "id"), 5).collect()
    assert len(rows) == 9 and all(np.allclose(r.powers, [np.linalg.matrix_power(m, p)[r.id, r.id] for p in range(1, 6)]) for r in rows)


def test_annotation(spark, graph):
    v, e, _ = graph
    labels, typed = annotate(v, e, "social", 0.0)
    assert {r.label for r in labels.collect()} <= {x for b in ("high", "mid", "low") for x, _ in G.PRESETS["social"][b]}
    assert all(r.type == G.PRESETS["social"]["types"][r.type_id - 1] for r in typed.collect())
    labels, typed = annotate(v, e, "universal", 0.4)
    bare = {r.id for r in labels.where("label is null").collect()}
    assert bare and all((r.type == "unknown") == (r.type_id == 0) == bool({r.src, r.dst} & bare) for r in typed.collect())
    assert all(abs(sum(w for _, w in x[b]) - 1) < 1e-9 for x in G.PRESETS.values() for b in ("high", "mid", "low"))


def test_size_law(spark):
    got = spark.range(20_000).select(P.size_law(P.uniform(1, "id"), 3, 5).alias("s")).groupBy("s").count().collect()
    w = {s: (s - 1) ** -1.1 for s in (3, 4, 5)}
    assert all(abs(r["count"] / 20_000 - w[r.s] / sum(w.values())) < 0.02 for r in got) and len(got) == 3


def test_trained_encoder_tells_contained_pairs(spark, tmp_path):
    """Pairs alike in size and degree: those alone tell next to nothing, the trained encoder does."""
    pairs = G.source("syn-balanced", spark, 1500)
    rows, label = L.pair_rows(pairs, 1500), np.array([r[0] for r in L.pair_rows(pairs, 1500)])[1200:]
    held = rows[1200:]
    top = lambda g: max(Counter(v for e in g[1] for v in e).values())
    for plain in (lambda a, b: top(a) - top(b), lambda a, b: -top(b), lambda a, b: len(a[0]) - len(b[0]), lambda a, b: -len(b[0]), lambda a, b: -len(b[1])):
        assert L.area(np.array([plain(a, b) for _, a, b in held], float), label) < 0.65
    spec = EncoderSpec(conv="sage", layers=3, hidden=24)
    losses = L.train(rows[:1200], spec, 20, margin=1.0)
    assert losses[-1] < losses[0] and L.area(-L.scores(held, spec), label) > 0.72
    spec.save(str(tmp_path / "w.npz"))
    again = EncoderSpec.load(str(tmp_path / "w.npz"), conv="sage", layers=3, hidden=24)
    assert np.array_equal(again.weights["pre"], spec.weights["pre"])
    g = spark.createDataFrame([(1, [0, 1], [0], [1], [0], 0), (2, [], [], [], [], 0)], "id long, labels array<int>, src array<int>, dst array<int>, types array<int>, anchor int")
    assert embed(g, again).count() == 2
    best = L.search_grid(rows[:60], rows[60:120], L.grid(layers=(2,)), 8, 1)
    assert len(best) == 4 and best[0][0] >= best[-1][0] and len(L.grid()) == 12


@pytest.mark.parametrize(("conv", "agg"), [("sage", "sum"), ("sage", "mean"), ("gin", "mean")])
def test_gradient(conv, agg):
    spec = EncoderSpec(conv=conv, layers=2, hidden=5, agg=agg)
    w = {k: x.astype(float) for k, x in spec.weights.items()}
    data = L._stacked([([1, 2, 3], [(0, 1), (1, 2)], 1), ([0, 4], [(0, 1)], 0)], 16)
    pull = np.random.default_rng(0).normal(size=(2, 5))
    out, cache = L._pass(spec, w, *data, 2)
    g = L._gradient(spec, w, *data, cache, pull)
    for k in ("pre", "nbr0", "gate1", "post1", "post2") + (("self1",) if conv == "sage" else ()):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        w[k][at] += 1e-6
        moved, _ = L._pass(spec, w, *data, 2)
        w[k][at] -= 1e-6
        assert g[k][at] == pytest.approx(((moved - out) * pull).sum() / 1e-6, rel=1e-3)


def test_head_and_projection(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    head = L.Head.fit(x[:300], y[:300], 32, 80)
    p = head.log_chances(x[300:])
    assert ((p[:, 1] > p[:, 0]) == y[300:]).mean() > 0.8 and np.allclose(np.exp(p).sum(1), 1)
    f = L.Projection.random().frame(text_vectors(spark.createDataFrame([("Gene",), ("TF",)], "label string"))).collect()
    assert len(f) == 2 and all(len(r.features) == 64 and abs(np.mean(r.features)) < 1e-6 for r in f)


def test_classes_split_a_hash(spark):
    rows = [("h", ["a", "a", "a"], [(0, 1, ""), (1, 2, "")]), ("h", ["a", "a", "a"], [(0, 2, ""), (2, 1, "")]), ("h", ["a", "a", "a"], [(0, 1, ""), (0, 2, "")])]
    got = C.classes(spark.createDataFrame(rows, "hash string, labels array<string>, arcs array<struct<src:int,dst:int,type:string>>")).collect()
    assert sorted((r.n, r.rank_in_hash) for r in got) == [(1, 2), (2, 1)]


def test_mined_classes_equal_brute_force(spark):
    """Isomorphism with labels and directions decided by trying all orders."""
    from itertools import permutations

    r, rows = random.Random(12), []
    for _ in range(150):
        n = r.randint(3, 4)
        rows.append(("h" * n, [r.choice("ab") for _ in range(n)], sorted({(a, b, "") for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(3)) if a != b})))
    least = lambda labels, arcs: min((tuple(labels[v] for v in p), tuple(sorted((p.index(a), p.index(b)) for a, b, _ in arcs))) for p in permutations(range(len(labels))))
    want = Counter((len(labels), least(labels, arcs)) for _, labels, arcs in rows)
    got = C.classes(spark.createDataFrame(rows, "hash string, labels array<string>, arcs array<struct<src:int,dst:int,type:string>>")).collect()
    assert sorted((x["size"], x.n) for x in got) == sorted((size, n) for (size, _), n in want.items())


def test_resume_and_metrics(spark, tmp_path):
    tasks, ran = spark.range(20).withColumnRenamed("id", "task"), spark.sparkContext.accumulator(0)
    T._cut(tasks)

    def work(left):
        ran.add(left.count())
        return left.select("task", (F.col("task") * 2).alias("n"), F.when(F.col("task") == 13, "slow").alias("error"))

    for _ in range(2):
        assert W.run_resumable(tasks, work, str(tmp_path / "r"), batches=3).count() == 19
    assert ran.value == 20 and [r.task for r in spark.read.parquet(str(tmp_path / "r/bad")).collect()] == [13]
    assert W.run_resumable(tasks.limit(0), work, str(tmp_path / "none"), batches=2).count() == 0
    for step in (1, 2):
        W.append_metrics(spark, str(tmp_path / "m"), "run", step, {"loss": 1 / step})
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    built = []
    for _ in range(2):
        assert D.read_through(spark, str(tmp_path / "c"), lambda: built.append(1) or spark.range(3)).count() == 3
    assert len(built) == 1
    found = spark.createDataFrame([(3, "a", 0.5), (4, "b", 0.1)], "size int, hash string, score double")
    W.beam_dump(found, str(tmp_path / "b"))
    assert {r["size"] for r in spark.read.parquet(str(tmp_path / "b")).collect()} == {3, 4}


def test_readers_of_many_graphs_and_ids(spark, tmp_path):
    (tmp_path / "g1.txt").write_text("1 2\n2 3\n")
    (tmp_path / "g2.txt").write_text("5 6\nx y\n")
    assert {(r.graph_id, r.src) for r in D.graph_files(spark, str(tmp_path)).collect()} == {("g1", 1), ("g1", 2), ("g2", 5)}
    ids = D.dense_ids(spark.range(0, 1000, 7).withColumnRenamed("id", "k").repartition(5), "k").orderBy("k").collect()
    assert [r.id for r in ids] == list(range(len(ids)))
    assert D.dense_ids(spark.range(0).withColumnRenamed("id", "k"), "k").count() == 0


def test_reports(spark):
    i = spark.createDataFrame([("p", k) for k in range(5)] + [("q", 9)], "pattern_key string, id int")
    assert [r.id for r in R.pattern_lookup(i, "p").collect()] == [0, 1, 2]
    v, g = spark.createDataFrame([(1, 7), (2, 8)], "id int, graph_id int"), spark.createDataFrame([(7, 0), (8, 1)], "graph_id int, label int")
    assert [r.id for r in R.labelled_zero(v, g).collect()] == [1]
