"""Triangles by blocks of lists."""

import random
from itertools import combinations

from graphloom.operators import traverse as T


def test_lists_go_once_to_each_block(spark):
    rng = random.Random(5)
    pairs = {(a, b) for a in range(70) for b in range(a) if rng.random() < 0.4} | {(1000 + i, 0) for i in range(200)}
    e = spark.createDataFrame([(a, b, None) for a, b in pairs], "src long, dst long, type string")
    met = T.closed(T.oriented(e)[0])
    got = [frozenset((r.u, r.v, w)) for r in met.collect() for w in r.thirds]
    has = {frozenset(p) for p in pairs}
    assert len(got) == len(set(got)) and set(got) == {frozenset(t) for t in combinations(range(70), 3) if all(frozenset(p) in has for p in combinations(t, 2))}
    # what crosses is a list a block, not a list an arc
    assert "MapInArrow" in met._jdf.queryExecution().toString() and "Join" not in met._jdf.queryExecution().toString()
    assert T.triangle_total(e.limit(0)).first().n == 0


def test_counting_writes_pairs_once_and_packed(spark, monkeypatch):
    from graphloom.operators import count as C
    from graphloom.operators import match as M

    rng = random.Random(7)
    pairs = {(a, b) for a in range(60) for b in range(a) if rng.random() < 0.5}
    e = spark.createDataFrame([(a, b, None) for a, b in pairs for _ in range(2)], "src long, dst long, type string")
    rows, kept, cut = [], [], T._cut
    for m in (C, T):
        monkeypatch.setattr(m, "_cut", lambda df: rows.append(df.count()) or cut(df))
    keep = T._kept
    for m in (C, T):
        monkeypatch.setattr(m, "_kept", lambda df: kept.append(df.columns) or keep(df))
    three = M.Pattern(dict.fromkeys("xyz"), [("x", "y", None), ("y", "z", None), ("x", "z", None)], directed=False)
    got = M.count_embeddings(three, spark.range(60), e).first()
    has = {frozenset(p) for p in pairs}
    assert got.frequency == sum(all(frozenset(p) in has for p in combinations(t, 2)) for t in combinations(range(60), 3)) > 0
    assert max(rows) <= 60  # no table of edges is a checkpoint of rows
    assert kept.count(["src", "dst"]) == 1
