"""Arcs that are dealt once as bucketed lists, and the rounds that read them, against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from graphloom.operators import traverse as T
from graphloom.operators.canon import wl_nodes


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hash")


def test_lists_hold_each_arc_once_and_are_not_dealt_again(spark):
    r = random.Random(3)
    rows = [(0, "h", i) for i in range(25_000)] + [(r.randrange(40), r.choice("xy"), r.randrange(60)) for _ in range(9_000)]
    rows += rows[::3]
    got = T.bucketed_lists(spark.createDataFrame(rows, "at long, how string, to long").repartition(5))
    flat = [(x.at, x.how, y) for x in got.collect() for y in x.to]
    assert len(flat) == len(set(rows)) and set(flat) == set(rows)
    assert max(map(len, (x.to for x in got.collect()))) <= 10_000
    state = spark.range(40).select(F.col("id").alias("at"))
    assert exchanges(got.join(state.hint("shuffle_hash"), "at")) == 1
    assert exchanges(got.groupBy("at").count()) == 0
    assert T.bucketed_lists(spark.createDataFrame([], "at long, to long")).count() == 0


def test_pagerank_of_repeats_loops_and_dangling_vertices(spark):
    r = random.Random(8)
    n, pairs = 60, [(r.randrange(50), r.randrange(60)) for _ in range(300)]
    pairs = [p for p in pairs if p[0] % 7] + [(3, 3), (9, 11), (9, 11)]
    edges = {p for p in pairs if p[0] != p[1]}
    out = Counter(a for a, _ in edges)
    rank = dict.fromkeys(range(n), 1 / n)
    for _ in range(4):
        lost = sum(x for i, x in rank.items() if i not in out)
        new = dict.fromkeys(range(n), 0.0)
        for a, b in edges:
            new[b] += rank[a] / out[a]
        rank = {i: 0.15 / n + 0.85 * (x + lost / n) for i, x in new.items()}
    got = {x.id: x["rank"] for x in T.pagerank(spark.range(n), spark.createDataFrame(pairs, "src long, dst long"), 4).collect()}
    assert got.keys() == rank.keys() and all(abs(got[i] - rank[i]) < 1e-12 for i in rank)


def test_structure_hashes_of_repeats_loops_and_types(spark):
    r = random.Random(4)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    labels = {i: r.choice(["a", "b", None]) for i in range(25)}
    edges = [(r.randrange(24), r.randrange(24), r.choice(["s", "t", None])) for _ in range(90)] + [(1, 2, "s"), (1, 2, "s"), (2, 1, "s"), (5, 5, "t")]
    v = spark.createDataFrame(list(labels.items()), "id long, label string")
    e = spark.createDataFrame(edges, "src long, dst long, type string")
    for directed in (True, False):
        arcs = [a for s, d, t in {(s, d, t or "") for s, d, t in edges if s != d} for a in ((s, d, f"f:{t}:"), (d, s, f"{'b' if directed else 'f'}:{t}:"))]
        h = {i: md5(x or "STRUCTURAL") for i, x in labels.items()}
        for _ in range(3):
            told = defaultdict(list)
            for i, nbr, how in arcs:
                told[i].append(md5(how + h[nbr]))
            bag = {i: ",".join([*(str(sum(int(m[8 * k : 8 * k + 8], 16) for m in ms)) for k in range(4)), str(len(ms))]) for i, ms in told.items()}
            h = {i: md5(f"{x}|{bag.get(i, '')}") for i, x in h.items()}
        last = wl_nodes(v, e, 3, directed)
        assert {x.id: x.hash for x in last.collect()} == h
        assert "Bucketed: true" in last._jdf.queryExecution().executedPlan().toString()
