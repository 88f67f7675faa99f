"""Betweenness, reach sketches, orbits, line numbers, running sums and stateful streams against plain computations."""

import random
from collections import Counter, deque
from itertools import combinations, permutations

import pytest
from pyspark.sql import functions as F

from graphloom.operators import enumerate as E
from graphloom.operators import features as X
from graphloom.operators import ranks
from graphloom.sources import readers as R
from graphloom.streaming import motifs


def random_pairs(r, n, m):
    return sorted({(min(a, b), max(a, b)) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(m)) if a != b})


def neighbours(pairs):
    nbr = {}
    for a, b in pairs:
        nbr.setdefault(a, set()).add(b)
        nbr.setdefault(b, set()).add(a)
    return nbr


def distances(nbr, s):
    d, todo = {s: 0}, deque([s])
    while todo:
        v = todo.popleft()
        for w in nbr.get(v, ()):
            if w not in d:
                d[w] = d[v] + 1
                todo.append(w)
    return d


def brute_betweenness(pairs):
    """By paths of every pair: those through v are the paths to it times the paths from it, where distances add up."""
    nbr = neighbours(pairs)
    dist = {v: distances(nbr, v) for v in nbr}

    def paths(s):
        n = {s: 1}
        for v in sorted(dist[s], key=dist[s].get):
            if v != s:
                n[v] = sum(n[w] for w in nbr[v] if dist[s][w] == dist[s][v] - 1)
        return n

    ways = {v: paths(v) for v in nbr}
    scale = (len(nbr) - 1) * (len(nbr) - 2) if len(nbr) > 2 else 1
    return {v: sum(ways[s][v] * ways[v][t] / ways[s][t] for s in nbr for t in dist[s] if v not in (s, t) and s != t and v in dist[s] and t in dist[v] and dist[s][v] + dist[v][t] == dist[s][t]) / scale for v in nbr}


def test_betweenness_by_layers(spark):
    r = random.Random(4)
    graphs = {1: random_pairs(r, 9, 14), 2: [(0, 1), (1, 2), (2, 3), (3, 0), (5, 6)], 3: [(7, 8)]}
    rows = [(g, a, b) for g, pairs in graphs.items() for a, b in pairs] + [(1, 3, 3)]
    got = {(x.graph_id, x.id): x.betweenness for x in X.betweenness(spark.createDataFrame(rows, "graph_id long, src long, dst long")).collect()}
    want = {(g, v): s for g, pairs in graphs.items() for v, s in brute_betweenness(pairs).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    one = spark.createDataFrame(random_pairs(r, 30, 60), "src long, dst long")
    exact = brute_betweenness([tuple(x) for x in one.collect()])
    whole = {x.id: x.betweenness for x in X.betweenness(one, by=()).collect()}
    assert all(whole[v] == pytest.approx(s) for v, s in exact.items())
    part = X.betweenness(one, spark.range(0, 30, 2), by=()).collect()
    assert len(part) == len(exact) and sum(x.betweenness for x in part) == pytest.approx(sum(exact.values()), rel=0.4)
    assert X.betweenness(one.limit(0), by=()).count() == 0


def test_reach_sketches(spark):
    pairs = random_pairs(random.Random(8), 60, 75)
    nbr = neighbours(pairs)
    v, e = spark.range(62), spark.createDataFrame(pairs, "src long, dst long")
    dist = {s: distances(nbr, s) for s in range(62)}
    reached = X.reach(v, e)
    rows = {(x.id, x.hop): x.reached for x in reached.collect()}
    assert all(rows[s, h] == sum(d <= h for d in dist[s].values()) for s, h in rows)
    mean = {x.id: x.mean_path for x in X.mean_distances(reached).collect()}
    for s in range(62):
        far = [d for d in dist[s].values() if d]
        assert mean[s] == (pytest.approx(sum(far) / len(far)) if far else None)
    all_ = [d for x in dist.values() for d in x.values() if d]
    s = X.distance_summary(reached).first()
    assert s.diameter == max(all_) and s.mean_path == pytest.approx(sum(all_) / len(all_))
    assert s.effective_diameter == min(h for h in range(99) if sum(d <= h for d in all_) >= 0.9 * len(all_))


def test_reach_of_larger_sets_is_within_three_percent(spark):
    pairs = random_pairs(random.Random(9), 1500, 4500)
    nbr = neighbours(pairs)
    reached = X.reach(spark.range(1500), spark.createDataFrame(pairs, "src long, dst long"))
    got = X.mean_distances(reached.where("id % 100 = 0")).collect()
    for x in got:
        far = [d for d in distances(nbr, x.id).values() if d]
        assert x.mean_path == pytest.approx(sum(far) / len(far), rel=0.03)


@pytest.mark.parametrize("size", [3, 4, 5])
def test_orbits_equal_enumeration(spark, size):
    pairs = random_pairs(random.Random(size), 9, 18)
    both = {p for a, b in pairs for p in ((a, b), (b, a))}
    patterns = X.rooted_patterns(size)
    assert len(patterns) == {3: 4, 4: 15, 5: 73}[size]
    place = {}
    for k, p in enumerate(patterns):
        names = sorted(p.nodes)
        arcs = {(names.index(a), names.index(b)) for a, b, _ in p.edges} | {(names.index(b), names.index(a)) for a, b, _ in p.edges}
        for perm in permutations(range(1, len(names))):
            order = (0, *perm)
            place[len(names), frozenset((i, j) for i in range(len(names)) for j in range(i) if (order[i], order[j]) in arcs)] = k
    want = Counter()
    for n in range(2, size + 1):
        for vs in combinations(range(9), n):
            for v in vs:
                order = (v, *(w for w in vs if w != v))
                k = place.get((n, frozenset((i, j) for i in range(n) for j in range(i) if (order[i], order[j]) in both)))
                if k is not None:
                    want[v, k] += 1
    got = X.orbit_counts(spark.range(10), spark.createDataFrame([(a, b, None) for a, b in pairs], "src long, dst long, type string"), size, chunk=12)
    rows = {x.id: x.orbits for x in got.collect()}
    assert {(v, k): n for v, row in rows.items() for k, n in enumerate(row) if n} == dict(want)
    assert rows[9] == [0] * len(patterns) and X.log_orbits(got).where("id = 9").first().v == [0.0] * len(patterns)


def test_line_numbers_across_splits(spark, tmp_path):
    r = random.Random(1)
    files = {}
    for f in ("a.txt", "b.txt", "c.txt"):
        files[f] = ["x" * r.randint(0, 40) + str(i) if r.random() < 0.9 else "" for i in range(r.randint(300, 700))]
        (tmp_path / f).write_text("\n".join(files[f]) + "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = R.numbered_lines(spark, str(tmp_path), "*.txt")
        assert df.rdd.getNumPartitions() > 3
        got = {(x.file.rsplit("/", 1)[-1], x.line): x.value for x in df.collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {(f, i): t for f, lines in files.items() for i, t in enumerate(lines, 1)}


def test_running_sums(spark):
    r = random.Random(3)
    rows = [(i, r.randint(0, 5)) for i in r.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "k long, x long").repartition(7)
    for own in (True, False):
        got = {x.k: x.t for x in ranks.running(df, [F.desc("k")], {"t": F.col("x")}, own).collect()}
        assert got == {k: sum(x for j, x in rows if j > k or (own and j == k)) for k, _ in rows}
    assert ranks.running(df.limit(0), [F.col("k")], {"t": F.col("x")}).count() == 0
    plan = ranks.running(df, [F.col("k")], {"t": F.col("x")})._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_stateful_stream_equals_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    r, t0 = random.Random(2), datetime(2024, 1, 1)
    rows = [(t0 + timedelta(minutes=r.randint(0, 3000), seconds=r.randint(0, 59)), r.randint(1, 6), r.choice("abc")) for _ in range(600)]
    rows.sort(key=lambda x: x[0] + timedelta(minutes=r.randint(0, 50)))  # late, but within the watermark
    schema = "ts timestamp, user_id long, event_type string"
    end = [(t0 + timedelta(days=9), 99, "a")]
    for i in range(4):
        spark.createDataFrame((rows + end)[i * 151 : (i + 1) * 151], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    spark.createDataFrame([(t0 + timedelta(days=9, minutes=5), 99, "b")], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "9"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        q = motifs.running_steps(motifs.edge_stream(stream, "2 hours")).writeStream.format("memory").queryName("steps").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        got = sorted(map(tuple, spark.table("steps").collect()))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    batch = motifs.steps(motifs.edge_stream(spark.createDataFrame(rows, schema)))
    assert len(got) > 50 and got == sorted(map(tuple, batch.collect()))


def test_sampled_sets_get_their_shapes(spark):
    e = spark.createDataFrame([(0, 1, None), (1, 2, None), (2, 3, None), (0, 2, None)], "src long, dst long, type string")
    sets = spark.createDataFrame([([0, 1, 2],), ([1, 2, 3],), ([0, 1, 3],)], "nodes array<long>")
    assert sorted((tuple(x.nodes), x.m, x.degrees) for x in E.joined_shapes(sets, e, 3).collect()) == [((0, 1, 2), 3, "2,2,2"), ((0, 1, 3), 1, "0,1,1"), ((1, 2, 3), 2, "1,1,2")]


def test_betweenness_folds_trees(spark):
    rng = random.Random(8)
    tree = [(i, rng.randrange(max(0, i - 9), i)) for i in range(1, 40)]
    ring = [(100 + i, 100 + (i + 1) % 8) for i in range(8)] + [(100, 103)] + [(200 + i, 100 + i % 5) for i in range(12)] + [(300 + i, 200 + i % 3) for i in range(6)] + [(400, 401)]
    near = {}
    for a, b in tree + ring:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    far, ways = {}, {}
    for s in near:
        d, n, todo = {s: 0}, {s: 1}, deque([s])
        while todo:
            x = todo.popleft()
            for y in near[x]:
                if y not in d:
                    d[y], n[y] = d[x] + 1, 0
                    todo.append(y)
                if d[y] == d[x] + 1:
                    n[y] += n[x]
        far[s], ways[s] = d, n
    starts = [s for s in near if s % 3 == 0]
    scale = len(near) / len(starts) / ((len(near) - 1) * (len(near) - 2))
    want = {v: scale * sum(ways[s][v] * ways[v][t] / ways[s][t] for s in starts for t in far[s] if v in far[s] and len({s, v, t}) == 3 and far[s][v] + far[v][t] == far[s][t]) for v in near}
    e = spark.createDataFrame(tree + ring, "src long, dst long")
    got = {r.id: r.betweenness for r in X.betweenness(e, spark.createDataFrame([(s,) for s in starts], "id long"), by=()).collect()}
    assert got == pytest.approx(want)
    # a tree is folded whole: no pair of vertices is left
    t = e.where("src < 100")
    adj = t.select(t.src.alias("id"), t.dst.alias("nbr")).union(t.select("dst", "src"))
    left, held, folds = X._peeled(adj, adj.select("id").distinct().withColumn("s", F.lit(1)), [])
    assert left.count() == 0 and held.collect()[0].w == 40 and sum(f.count() for f in folds) == 39
