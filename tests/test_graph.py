import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalar as S
from graphloom.graph import induced_edges, non_edges
from graphloom.operators import canon, enumerate as enum, evaluate, match as M, report, traverse as T, vocab
from graphloom.operators.features import betweenness, motif_embedding


def frames(spark, n, edges, label="x", kind=None):
    v = spark.createDataFrame([(i, label) for i in range(n)], "id long, label string")
    e = spark.createDataFrame([(a, b, kind) for a, b in edges], "src long, dst long, type string")
    return v, e


K4 = (4, list(itertools.combinations(range(4), 2)))
C4 = (4, [(0, 1), (1, 2), (2, 3), (0, 3)])
P4 = (4, [(0, 1), (1, 2), (2, 3)])
S5 = (5, [(0, 1), (0, 2), (0, 3), (0, 4)])
WEDGE = M.Pattern({"a": None, "m": None, "b": None}, [("a", "m", None), ("m", "b", None)], directed=False)
TRIANGLE = M.Pattern({"x": None, "y": None, "z": None}, [("x", "y", None), ("y", "z", None), ("x", "z", None)], directed=False)


@pytest.mark.parametrize("graph,triangles,wedges,induced", [(K4, 4, 12, 0), (C4, 0, 4, 4), (P4, 0, 2, 2), (S5, 0, 6, 6)])
def test_closed_forms(spark, graph, triangles, wedges, induced):
    v, e = frames(spark, *graph)
    assert M.count_embeddings(TRIANGLE, v, e).first().frequency == triangles
    assert T.triangles(e).count() == triangles
    assert M.count_embeddings(WEDGE, v, e).first().frequency == wedges
    assert M.match(WEDGE.induced(), v, e, unique=True).count() == induced


@pytest.mark.parametrize("graph,group", [(K4, 24), (C4, 8), (P4, 2), (S5, 24)])
def test_automorphisms(graph, group):
    names = [f"v{i}" for i in range(graph[0])]
    p = M.Pattern(dict.fromkeys(names), [(f"v{a}", f"v{b}", None) for a, b in graph[1]], directed=False)
    assert len(p.automorphisms()) == group


def test_directed_transitive_triangle(spark):
    v, e = frames(spark, 3, [(0, 1), (1, 2), (0, 2)])
    p = M.Pattern({"a": None, "b": None, "c": None}, [("a", "b", None), ("b", "c", None), ("a", "c", None)])
    assert M.count_embeddings(p, v, e).first().asDict() == {"n_embeddings": 1, "n_automorphisms": 1, "frequency": 1}


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, seed):
    r = random.Random(seed)
    n = 7
    edges = {(a, b): r.choice("st") for a in range(n) for b in range(n) if a != b and r.random() < 0.3}
    labels = [r.choice("xy") for _ in range(n)]
    v = spark.createDataFrame(list(enumerate(labels)), "id long, label string")
    e = spark.createDataFrame([(a, b, t) for (a, b), t in edges.items()], "src long, dst long, type string")
    p = M.Pattern({"a": "x", "b": None, "c": None, "d": "y"}, [("a", "b", "s"), ("b", "c", None), ("c", "d", "t")])
    for q in (p, p.induced()):
        want = set()
        for m in itertools.permutations(range(n), 4):
            at = dict(zip("abcd", m, strict=True))
            fits = labels[at["a"]] == "x" and labels[at["d"]] == "y" and all((at[x], at[y]) in edges and t in (None, edges[at[x], at[y]]) for x, y, t in q.edges)
            if fits and not any((at[x], at[y]) in edges for x, y in q.absent):
                want.add(m)
        got = [tuple(x) for x in M.match(q, v, e).select("a", "b", "c", "d").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_isolated_and_loops(spark):
    v, e = frames(spark, 6, [*K4[1], (5, 5)])
    assert {r.id for r in T.non_isolated(v, e).collect()} == {0, 1, 2, 3}
    assert T.triangles(e).count() == 4


def test_traversal(spark):
    v, e = frames(spark, *P4)
    d = {(r.seed, r.id): r.depth for r in T.khop(e, v, 3).collect()}
    assert d[0, 3] == 3 and len(d) == 16
    assert {r.id for r in T.bfs_ball(e, v.where("id = 1"), 3, 3).collect()} == {0, 1, 2}
    assert induced_edges(e, v.where("id <> 1")).count() == 1
    assert non_edges(v, e).count() == 3


def test_components_of_long_path(spark):
    n = 60
    v, e = frames(spark, n + 2, [(i, i + 1) for i in range(n - 1)] + [(n, n + 1)])
    got = {r.id: r.component for r in T.components(v, e).collect()}
    assert set(got.values()) == {0, n} and got[n - 1] == 0
    assert T.largest_component(T.components(v, e)).count() == n


def test_hash_is_invariant_and_types_count(spark):
    e = [(0, 1, "x"), (0, 2, "x"), (3, 4, "y")]
    v = spark.createDataFrame([(i, "n") for i in range(5)], "id long, label string")
    h = {r.id: r.hash for r in canon.wl_nodes(v, spark.createDataFrame(e, "src long, dst long, type string"), 2).collect()}
    assert h[0] != h[3] and h[1] == h[2] != h[4]
    perm = [4, 3, 2, 1, 0]
    h2 = {r.id: r.hash for r in canon.wl_nodes(v, spark.createDataFrame([(perm[a], perm[b], t) for a, b, t in e], "src long, dst long, type string"), 2).collect()}
    assert all(h[i] == h2[perm[i]] for i in range(5))


def test_canonical_code_under_relabelling():
    r = random.Random(5)
    for _ in range(30):
        n = r.randint(2, 5)
        labels = [r.choice("ab") for _ in range(n)]
        arcs = [(i, j, r.choice("st")) for i in range(n) for j in range(n) if i != j and r.random() < 0.4]
        p = list(range(n))
        r.shuffle(p)
        moved = [None] * n
        for i in range(n):
            moved[p[i]] = labels[i]
        assert S.canonical_code(n, arcs, labels) == S.canonical_code(n, [(p[a], p[b], t) for a, b, t in arcs], moved)


def test_connected_sets(spark):
    _, e = frames(spark, *C4)
    assert enum.connected_sets(e, 3).count() == 4 and enum.connected_sets(e, 4).count() == 1
    assert [tuple(r) for r in enum.motif_counts(e, 4).collect()] == [("2,2,2,2", 4, 1)]


def test_containment_of_motif_vectors(spark):
    _, small = frames(spark, *P4)
    _, large = frames(spark, *K4)
    a = {r.id: r.v for r in motif_embedding(large).collect()}[0]
    assert a[0] == 3 and a[3] == 3


def test_labels(spark):
    rows = [(None,), ("",), (" unk ",), ("None",), ("Gene",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(S.safe_label(F.col("t"))).collect()]
    assert got == ["STRUCTURAL", "STRUCTURAL", "UNKNOWN", "UNKNOWN", "Gene"]
    S.register(spark)
    assert spark.sql("SELECT safe_label(' nan '), order_violation(array(1D, 2D), array(2D, 1D)), stable_id('x') = stable_id('x')").first()[:] == ("UNKNOWN", 1.0, True)


def test_vocabulary(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "l string")
    v = vocab.build(df.where("l <> 'c'"), "l")
    assert {r.l: r.i for r in vocab.encode(df, "l", v, "i").collect()} == {"a": 1, "b": 2, None: 0, "c": 0}
    with pytest.raises(ValueError):
        vocab.check({"vocab_version": "v0"})
    with pytest.raises(FileNotFoundError):
        vocab.check(None, required=True)


def test_metrics(spark):
    rows = [(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.1, 0)]
    s = spark.createDataFrame(rows, "score double, label int")
    pairs = [(a, b) for a, y in rows for b, z in rows if y == 1 and z == 0]
    assert evaluate.auroc(s).first()[0] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs))
    assert evaluate.average_precision(s).first()[0] == pytest.approx((1 + 2 / 4) / 2)


def test_rates_and_ranks(spark):
    i = spark.createDataFrame([("p", [1, 2]), ("p", [2, 1]), ("p", [3])], "pattern string, nodes array<long>")
    r = report.instance_rates(i, 10).first()
    assert (r.original_count, r.unique_count, r.duplicates_removed) == (3, 2, 1)
    t = spark.createDataFrame([(1,), (2,), (3,)], "task_id long")
    assert [x.task_id for x in report.open_tasks(t, t.where("task_id = 1"), t.where("task_id = 3")).collect()] == [2]


def test_betweenness_of_a_path(spark):
    g = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "graph_id long, src long, dst long")
    assert {r.id: r.betweenness for r in betweenness(g).collect()} == {0: 0.0, 1: 1.0, 2: 0.0}


def test_non_edges_shuffle_no_pairs(spark, monkeypatch):
    import random
    from itertools import combinations

    from graphloom import graph as G

    monkeypatch.setattr(G, "SIDE", 16)
    rng = random.Random(2)
    have = {(a, b) for a, b in combinations(range(90), 2) if rng.random() < 0.3 or a == 7}
    e = spark.createDataFrame([(b, a) if (a + b) % 2 else (a, b) for a, b in have] + [(5, 5)], "src long, dst long")
    got = G.non_edges(spark.range(90), e)
    assert sorted(map(tuple, got.collect())) == sorted(set(combinations(range(90), 2)) - have)
    assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_hub_joins_are_dealt(spark):
    from graphloom.operators import match as M

    v = spark.createDataFrame([(0, "hub"), (1, "hub")] + [(10 + i, "a") for i in range(50)] + [(100 + i, "b") for i in range(30)], "id long, label string")
    e = spark.createDataFrame([(10 + i, i % 2, "t") for i in range(50)] + [(100 + i, i % 2, "t") for i in range(30)], "src long, dst long, type string")
    star = M.Pattern({"h": "hub", "x": "a", "y": "b"}, [("x", "h", "t"), ("y", "h", "t")])
    plain, dealt = M.match(star, v, e), M.match(star, v, e, hubs=("h",))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, dealt.collect())) and dealt.rdd.getNumPartitions() >= M.PIECES > plain.rdd.getNumPartitions()
