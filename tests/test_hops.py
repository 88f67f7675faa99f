"""Hops over lists of neighbours that are dealt once."""

import random

from graphloom.operators import sample as P
from graphloom.operators import traverse as T


def written(monkeypatch, *modules):
    """Row counts of what is checkpointed from now on."""
    rows, cut = [], T._cut

    def told(df):
        out = cut(df)
        rows.append(out.count())
        return out

    for m in modules:
        monkeypatch.setattr(m, "_cut", told)
    return rows


def distances(near, s, cutoff):
    found, layer = {s: 0}, {s}
    for d in range(1, cutoff + 1):
        layer = {y for x in layer for y in near.get(x, ())} - found.keys()
        found |= dict.fromkeys(layer, d)
    return found


def test_khop_writes_no_last_layer(spark, monkeypatch):
    r = random.Random(4)
    pairs = [(0, i) for i in range(1, 400)] + [(r.randrange(400, 440), r.randrange(400, 440)) for _ in range(60)] + [(5, 400), (400, 5), (0, 7)]
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    seeds = [*range(1, 30), 401, 402, 999]
    rows = written(monkeypatch, T)
    e, s = spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(x,) for x in seeds], "id long")
    for cutoff in (1, 2, 3):
        got = [tuple(x) for x in T.khop(e, s, cutoff).collect()]
        assert len(got) == len(set(got)) and set(got) == {(x, y, d) for x in seeds for y, d in distances(near, x, cutoff).items()}
        if cutoff == 2:
            assert max(rows) < 100 and len(got) > 10_000  # 29 leaves reach all others over the hub
    assert T.khop(e, s.limit(0), 2).count() == 0 and T.khop(e.limit(0), s, 2).count() == len(seeds)


def test_khop_of_directed_edges(spark):
    e, s = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (2, 2)], "src long, dst long"), spark.createDataFrame([(1,), (4,)], "id long")
    assert {tuple(x) for x in T.khop(e, s, 2, both_ways=False).collect()} == {(1, 1, 0), (1, 2, 1), (1, 3, 2), (4, 4, 0), (4, 1, 1), (4, 2, 2)}


def test_baselines_deal_the_graph_once(spark, monkeypatch, tmp_path):
    from graphloom.queries import QUERIES

    r = random.Random(6)
    lines = [(o, p) for o in range(300) for p in r.sample(range(1, 60), 4)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, f"Brand#{p % 3}") for p in range(1, 60)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    rows, dealt, lists = written(monkeypatch, T, P), [], T.bucketed_lists
    monkeypatch.setattr(T, "bucketed_lists", lambda arcs: dealt.append(arcs.columns) or lists(arcs))
    got = QUERIES["baseline_queries"](spark, str(tmp_path)).collect()
    assert len(dealt) == 1 and max(rows) < 100  # pairs of parts are not written besides
    assert {(x.kind, x.pattern) for x in got} == {(k, i) for k in ("tree", "radial") for i in range(12)}
    assert all(sum(x.kind == k and x.pattern == i for x in got) == 3 + i % 4 for k in ("tree", "radial") for i in range(12))
