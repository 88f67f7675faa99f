"""Vertex and graph features as frames."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalar import bin_of, label_bucket, one_hot
from graphloom.graph import adjacency, degrees
from graphloom.operators.count import Elimination, least_form, signed
from graphloom.operators.enumerate import class_codes
from graphloom.operators import places
from graphloom.operators.match import Pattern
from graphloom.operators.traverse import _cut, clustering, components, khop, pagerank

#: Features by name: a function of (vertices, edges) to a frame (id, <name>). register() adds to it.
REGISTRY: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def register(name: str, build: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    REGISTRY[name] = build


def degree_one_hot(edges: DataFrame, width: int) -> DataFrame:
    return degrees(edges).select("id", one_hot(F.col("degree"), width).alias("degree_one_hot"))


def degree_buckets(edges: DataFrame, low: float = 0.35, high: float = 0.75) -> DataFrame:
    """(id, degree, bucket): high from the upper percentile on, low up to the lower one, else mid."""
    d = degrees(edges)
    cut = d.agg(F.percentile("degree", F.lit(low)).alias("q1"), F.percentile("degree", F.lit(high)).alias("q2"))
    return d.crossJoin(F.broadcast(cut)).select("id", "degree", F.when(F.col("degree") >= F.col("q2"), "high").when(F.col("degree") <= F.col("q1"), "low").otherwise("mid").alias("bucket"))


def label_one_hot(encoded: DataFrame, width: int = 16) -> DataFrame:
    return encoded.select("id", one_hot(label_bucket(F.col("label_id"), width), width).alias("label_one_hot"))


def mean_path_length(edges: DataFrame, seeds: DataFrame, cutoff: int) -> DataFrame:
    """(id, mean_path): a seed's mean distance to what it reaches within cutoff."""
    return khop(edges, seeds, cutoff).where("depth > 0").groupBy(F.col("seed").alias("id")).agg(F.avg("depth").alias("mean_path"))


def graph_stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n, m, largest and mean degree, directions ignored. How many components there are is count_components(): it takes rounds of its own."""
    d = degrees(edges)
    deg = d.agg(F.max("degree").alias("max_degree"), (F.sum("degree") / 2).cast("long").alias("m"))
    n = vertices.agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(deg)).select("n", F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("max_degree", F.lit(0)).alias("max_degree"), (2 * F.coalesce("m", F.lit(0)) / F.col("n")).alias("avg_degree"))


def count_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """n_components, vertices without neighbours included."""
    return components(vertices, edges).agg(F.countDistinct("component").alias("n_components"))


def graph_stats_by(vertices: DataFrame, edges: DataFrame, by: str = "graph_id") -> DataFrame:
    """(graph_id, n, m, max_degree, avg_degree) of each graph of a collection; ids are unique over it."""
    own = vertices.select("id", F.col(by).alias("graph_id"))
    d = own.join(degrees(edges), "id", "left")
    k = F.coalesce("degree", F.lit(0))
    return d.groupBy("graph_id").agg(F.count("*").alias("n"), (F.sum(k) / 2).cast("long").alias("m"), F.max(k).alias("max_degree"), F.avg(k).alias("avg_degree"))


def mean_clustering(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: mean_clustering over all vertices (none for those with less than two neighbours) and transitivity, the share of open and closed triples that are closed."""
    c = clustering(edges).agg(F.sum("clustering").alias("c"), F.sum("triangles").alias("t"), F.sum(F.col("degree") * (F.col("degree") - 1) / 2).alias("w"))
    n = vertices.agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(c)).select(F.try_divide(F.coalesce("c", F.lit(0.0)), "n").alias("mean_clustering"), F.coalesce(F.try_divide("t", "w"), F.lit(0.0)).alias("transitivity"))  # one row each


def degree_sequence(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("degree").agg(F.count("*").alias("n"))


def inverse_sqrt_degree(edges: DataFrame) -> DataFrame:
    return degrees(edges).select("id", F.pow("degree", F.lit(-0.5)).alias("norm"))


def identity_powers(edges: DataFrame, vertices: DataFrame, k: int) -> DataFrame:
    """(graph_id, id, powers array<double>): the diagonal of the first k powers of the adjacency normalised by both ends' degrees, of graphs (graph_id, src, dst) and (graph_id, id).

    The matrix is symmetric, so a diagonal entry of a power is a sum of products of two rows of powers half as high: half of k rounds of sparse rows (graph_id, id, x) are made, each a join with the
    adjacency and an aggregate. No graph is in one task. A vertex without edges has zeros.
    """
    e = edges.where("src <> dst")
    both = e.select("graph_id", F.col("src").alias("x"), F.col("dst").alias("y")).unionByName(e.select("graph_id", F.col("dst").alias("x"), F.col("src").alias("y"))).distinct()
    norm = both.groupBy("graph_id", "x").agg((F.count("*") ** F.lit(-0.5)).alias("d"))
    a = _cut(both.join(norm, ["graph_id", "x"]).join(norm.select("graph_id", F.col("x").alias("y"), F.col("d").alias("e")), ["graph_id", "y"]).select("graph_id", "x", "y", (F.col("d") * F.col("e")).alias("a")))
    rows = [vertices.select("graph_id", "id", F.col("id").alias("x"), F.lit(1.0).alias("w")).distinct()]
    while len(rows) <= (k + 1) // 2:
        step = rows[-1].join(a, ["graph_id", "x"]).groupBy("graph_id", "id", F.col("y").alias("x")).agg(F.sum(F.col("w") * F.col("a")).alias("w"))
        rows.append(_cut(step))
    out = vertices.select("graph_id", "id").distinct()
    for p in range(1, k + 1):
        left, right = rows[p // 2], rows[p - p // 2].withColumnRenamed("w", "w2")
        met = left.join(right, ["graph_id", "id", "x"]).groupBy("graph_id", "id").agg(F.sum(F.col("w") * F.col("w2")).alias(f"p{p}"))
        out = out.join(met, ["graph_id", "id"], "left")
    return out.select("graph_id", "id", F.array(*(F.coalesce(f"p{p}", F.lit(0.0)) for p in range(1, k + 1))).alias("powers"))


def _peeled(adj: DataFrame, marks: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(adj, held, folds): leaves are folded onto their neighbour, round by round, as long as a round takes an eighth of the vertices that are left.

    marks (*by, id, s): 1 for a source. held (*by, id, w, s, own, across) of the vertices left: vertices and sources folded into each, itself included, those sources without its own, and the sum of
    w * s over what was folded onto it; folds has the same of what was folded, with up, the vertex it went to.
    """
    zero = F.lit(0).cast("long")
    held, folds = _cut(marks.select(*by, "id", F.lit(1).cast("long").alias("w"), F.col("s").cast("long").alias("s"), zero.alias("own"), zero.alias("across"))), []
    while True:
        ends = adj.groupBy(*by, "id").agg(F.count("*").alias("k"), F.max("nbr").alias("up"))
        ones = _cut(ends.where("k = 1").select(*by, "id", "up"))
        # of two leaves that are joined the smaller id stays
        back = ones.select(*by, F.col("id").alias("up"), F.lit(True).alias("mutual"))
        leaves = _cut(ones.join(back, [*by, "up"], "left").where("mutual is null or id > up").select(*by, "id", "up"))
        n = leaves.count()
        if not n or 8 * n < held.count():
            return adj, held, folds
        gone = _cut(held.join(leaves, [*by, "id"]))
        folds.append(gone)
        got = gone.groupBy(*by, F.col("up").alias("id")).agg(F.sum("w").alias("w2"), F.sum("s").alias("s2"), F.sum(F.col("w") * F.col("s")).alias("a2"))
        add = lambda c, d: (F.col(c) + F.coalesce(d, zero)).alias(c)
        held = _cut(held.join(leaves, [*by, "id"], "left_anti").join(got, [*by, "id"], "left").select(*by, "id", add("w", "w2"), add("s", "s2"), add("own", "s2"), add("across", "a2")))
        names = leaves.select(*by, "id")
        adj = _cut(adj.join(names, [*by, "id"], "left_anti").join(names.withColumnRenamed("id", "nbr"), [*by, "nbr"], "left_anti").select(*by, "id", "nbr"))


def _wholes(adj: DataFrame, held: DataFrame, folds: list[DataFrame], by: list[str]) -> DataFrame:
    """Rows of held and folds with all_w and all_s: vertices and sources of the component."""
    spread = held.select(*by, "id", F.struct(*by, "id").alias("node"))
    key = spread.select(*by, "id", F.xxhash64("node").alias("key")) if by else spread.select("id", F.col("id").alias("key"))
    key = _cut(key)
    ends = adj.join(key.withColumnRenamed("key", "src"), [*by, "id"]).join(key.select(*by, F.col("id").alias("nbr"), F.col("key").alias("dst")), [*by, "nbr"]).select("src", "dst")
    part = components(key.select(F.col("key").alias("id")), ends).withColumnRenamed("id", "key")
    rows = _cut(held.join(key, [*by, "id"]).join(part, "key").drop("key"))
    size = rows.groupBy(*by, "component").agg(F.sum("w").alias("all_w"), F.sum("s").alias("all_s"))
    kept = ["id", "w", "s", "own", "across", "all_w", "all_s"]
    done = [_cut(rows.join(size, [*by, "component"]).select(*by, *kept))]
    for gone in reversed(folds):
        known = reduce(DataFrame.unionByName, done).select(*by, F.col("id").alias("up"), "all_w", "all_s")
        done.append(_cut(gone.join(known, [*by, "up"]).select(*by, *kept)))
    return reduce(DataFrame.unionByName, done)


def betweenness(edges: DataFrame, sources: DataFrame | None = None, by: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """(*by, id, betweenness) of undirected graphs, edges (*by, src, dst): the share of shortest paths between other vertices that pass through each.

    sources (*by, id): the vertices that paths start from; all by default, else an estimate, scaled by how many of a graph's vertices they are. Leaves are folded first: whatever leads to a tree that
    hangs at a vertex passes through it, so its share follows from sums of vertices and sources, and a tree makes no rows of pairs. On what is left, layer by layer, a
    join of the newest layer with the adjacency adds up path counts; backward, each layer passes on what depends on it. Rows are pairs of a source and a reached vertex, grouped by both: no graph is in
    one task. Vertices without edges have no row; a loop is no edge.
    """
    by = list(by)
    e = edges.where("src <> dst").select(*by, F.col("src").alias("id"), F.col("dst").alias("nbr"))
    adj = _cut(e.unionByName(e.select(*by, F.col("nbr").alias("id"), F.col("id").alias("nbr"))).distinct())
    vertices = _cut(adj.select(*by, "id").distinct())
    starts = _cut(vertices if sources is None else sources.select(*by, "id").distinct().join(vertices, [*by, "id"], "left_semi"))
    marks = vertices.join(starts.withColumn("s", F.lit(1)), [*by, "id"], "left").select(*by, "id", F.coalesce("s", F.lit(0)).alias("s"))
    adj, held, folds = _peeled(adj, marks, by)
    hung = _wholes(adj, held, folds, by)
    # from one hanging tree to all else, and from all else to the hanging trees
    score = hung.select(*by, "id", (F.col("own") * (F.col("all_w") - 1) - F.col("across") + (F.col("all_s") - F.col("s")) * (F.col("w") - 1)).cast("double").alias("score"))
    core = _cut(held.join(adj.select(*by, "id").distinct(), [*by, "id"], "left_semi"))
    key = [*by, "source", "id"]
    layers = [_cut(core.where("s > 0").select(*by, F.col("id").alias("source"), "id", F.lit(1.0).alias("paths")))]
    while not layers[-1].isEmpty():
        found = layers[-1].join(adj, [*by, "id"]).groupBy(*by, "source", F.col("nbr").alias("id")).agg(F.sum("paths").alias("paths"))
        for known in layers[-2:]:  # a neighbour of a layer is in it or in one of the two next to it
            found = found.join(known.select(*key), key, "left_anti")
        layers.append(_cut(found))
    layers.pop()
    weight, many = core.select(*by, "id", "w"), core.select(*by, F.col("id").alias("source"), F.col("s").alias("many"))
    if len(layers) > 2:
        need = [layers[-1].withColumn("need", F.lit(0.0))]
        for layer in reversed(layers[1:-1]):
            owed = need[-1].join(weight, [*by, "id"]).join(adj, [*by, "id"]).groupBy(*by, "source", F.col("nbr").alias("id")).agg(F.sum((F.col("w") + F.col("need")) / F.col("paths")).alias("owed"))
            need.append(_cut(layer.join(owed, key, "left").select(*key, "paths", (F.col("paths") * F.coalesce("owed", F.lit(0.0))).alias("need"))))
        met = reduce(DataFrame.unionByName, need).join(many, [*by, "source"])
        score = score.unionByName(met.groupBy(*by, "id").agg(F.sum(F.col("need") * F.col("many")).alias("score")))
    score = score.groupBy(*by, "id").agg(F.sum("score").alias("score"))
    sizes = vertices.groupBy(*by).agg(F.count("*").alias("n")) if by else vertices.agg(F.count("*").alias("n"))
    drawn = starts.groupBy(*by).agg(F.count("*").alias("k")) if by else starts.agg(F.count("*").alias("k"))
    scale = sizes.join(drawn, by) if by else sizes.crossJoin(F.broadcast(drawn))  # one row a graph
    out = vertices.join(score, [*by, "id"], "left")
    out = out.join(scale, by) if by else out.crossJoin(F.broadcast(scale))
    pairs = F.when(F.col("n") > 2, (F.col("n") - 1) * (F.col("n") - 2)).otherwise(1)
    return out.select(*by, "id", (F.coalesce("score", F.lit(0.0)) * F.col("n") / F.col("k") / pairs).alias("betweenness"))


def reach(vertices: DataFrame, edges: DataFrame, most: int = 32, lg_k: int = 12) -> DataFrame:
    """(id, hop, reached): how many vertices, itself included, each vertex has within so many hops, directions ignored.

    A vertex holds a sketch of the vertices within reach, of at most some 2 ** lg_k bytes; a hop merges its neighbours' sketches into it, pre-aggregated, so a
    round is one shuffle of sketches whatever the sets' sizes. Estimates have a relative deviation of about 0.8 / sqrt(2 ** lg_k), 1.2 % by default, and are
    exact up to some hundreds. Ends when a hop adds nothing anywhere, or after `most`: the last hop is the diameter of the largest component, as the sketches tell it.
    """
    adj = _cut(adjacency(edges))
    state = _cut(vertices.groupBy("id").agg(F.hll_sketch_agg("id", F.lit(lg_k)).alias("sketch")))
    told = lambda df, hop: df.select("id", F.lit(hop).alias("hop"), F.hll_sketch_estimate("sketch").alias("reached"))
    out, total = [told(state, 0)], None
    for hop in range(1, most + 1):
        sent = adj.join(state.select(F.col("id").alias("nbr"), "sketch"), "nbr").select("id", "sketch")
        state = _cut(sent.unionByName(state).groupBy("id").agg(F.hll_union_agg("sketch").alias("sketch")))
        now = told(state, hop).agg(F.sum("reached")).first()[0]
        if now == total:
            break
        out.append(told(state, hop))
        total = now
    return reduce(DataFrame.unionByName, out)


def mean_distances(reached: DataFrame) -> DataFrame:
    """(id, others, mean_path) of rows of reach(): how many other vertices a vertex reaches and its mean distance to them; null where there are none."""
    last, hops = F.max("reached"), F.max("hop")
    t = reached.groupBy("id").agg(last.alias("all"), hops.alias("hops"), F.sum("reached").alias("within"))
    others = F.col("all") - 1
    # a vertex at distance d is missing from the first d of the counts
    return t.select("id", others.alias("others"), F.try_divide(F.col("all") * (F.col("hops") + 1) - F.col("within"), others).alias("mean_path"))


def distance_summary(reached: DataFrame) -> DataFrame:
    """One row of reach(): diameter (of the component with the largest), mean distance over all pairs that reach each other, and effective diameter, the least hop within which nine tenths of those pairs are."""
    by_hop = reached.groupBy("hop").agg(F.sum("reached").alias("pairs"))
    hops = {r.hop: r.pairs for r in by_hop.collect()}  # a row a hop
    top = max(hops, default=0)
    own, all_ = hops.get(0, 0), hops.get(top, 0)
    grew = [h for h in range(1, top + 1) if hops[h] > hops[h - 1]]
    mean = sum(h * (hops[h] - hops[h - 1]) for h in range(1, top + 1)) / (all_ - own) if all_ > own else None
    most = next((h for h in range(top + 1) if hops.get(h, 0) - own >= 0.9 * (all_ - own)), 0)
    return reached.sparkSession.createDataFrame([(max(grew, default=0), mean, most)], "diameter int, mean_path double, effective_diameter int")


def rooted_patterns(size: int) -> list[Pattern]:
    """A pattern for each place (orbit) of the connected graphs of 2 to `size` vertices, at most five: 4, 15 or 73 places. By size, edges, the graph's least code, then the place; variable a is the place."""
    out = []
    for n in range(2, size + 1):
        pairs = [(i, j) for i in range(n) for j in range(i)]
        graphs = []
        for code in set(class_codes(n).values()):
            arcs = [p for k, p in enumerate(pairs) if code >> k & 1]
            seen, todo = {0}, [0]
            while todo:
                v = todo.pop()
                fresh = {a + b - v for a, b in arcs if v in (a, b)} - seen
                seen |= fresh
                todo += fresh
            if len(seen) == n:
                graphs.append((len(arcs), code, arcs))
        for _, _, arcs in sorted(graphs):
            places = set()
            for v in range(n):
                form = least_form([None] * n, {(min(a, b), max(a, b), None) for a, b in arcs}, False, v)
                if form not in places:
                    places.add(form)
                    names = ["abcde"[(i - v) % n] for i in range(n)]
                    out.append(Pattern(dict.fromkeys("abcde"[:n]), [(names[a], names[b], None) for a, b in arcs], directed=False, anchor="a"))
    return out


def orbit_counts(vertices: DataFrame, edges: DataFrame, size: int = 4, chunk: int = 6) -> DataFrame:
    """(id, orbits array<long>): how often each vertex holds each place of rooted_patterns(size), induced; 15 numbers up to four vertices, 73 up to five.

    A system of equations solved by its rule: an induced count is a signed sum of rooted homomorphism counts (merged vertices, edges added), which elimination gets from degrees, shared
    neighbours of edges and what is left of larger cycles. Each homomorphism count is made once, and a vertex's row is their linear combination. Vertices without edges have zeros.
    Up to four vertices the equations are solved by hand, in places().
    """
    patterns = rooted_patterns(size)
    if size == 4:
        known = {}
        for i, p in enumerate(patterns):
            degree = {v: sum(v in e[:2] for e in p.edges) for v in p.nodes}
            known[i] = places.name((len(p.edges), "".join(map(str, sorted(degree.values()))), degree["a"]))
        rows = places.places(edges).select("id", F.array(*known.values()).alias("orbits"))
        return vertices.select("id").join(rows, "id", "left").select("id", F.coalesce("orbits", F.array_repeat(F.lit(0).cast("bigint"), len(patterns))).alias("orbits"))
    systems = [signed(p.induced(), "a") for p in patterns]
    forms = sorted({f for s in systems for f in s})
    place = {f: i for i, f in enumerate(forms)}
    engine = Elimination(vertices.select("id", F.lit(None).cast("string").alias("label")), edges, False)
    made = []
    for at in range(0, len(forms), chunk):
        made.append(_cut(reduce(DataFrame.unionByName, (engine.count(f).select("id", F.lit(place[f]).alias("form"), "n") for f in forms[at : at + chunk]))))
    rows = reduce(DataFrame.unionByName, made).groupBy("id").agg(*(F.sum(F.when(F.col("form") == i, F.col("n")).otherwise(0)).cast("decimal(38,0)").alias(f"h{i}") for i in range(len(forms))))
    same = [len(p.automorphisms()) for p in patterns]
    orbit = [(sum((F.col(f"h{place[f]}") * F.lit(sign) for f, sign in s.items()), F.lit(0)) / F.lit(k)).cast("bigint") for s, k in zip(systems, same, strict=True)]
    none = F.array_repeat(F.lit(0).cast("bigint"), len(patterns))
    return vertices.select("id").join(rows.select("id", F.array(*orbit).alias("orbits")), "id", "left").select("id", F.coalesce("orbits", none).alias("orbits"))


def log_orbits(orbits: DataFrame) -> DataFrame:
    """(id, v): ln(1 + count) of each place, as features."""
    return orbits.select("id", F.transform("orbits", lambda x: F.log1p(x)).alias("v"))


def edge_features(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    return df.withColumn("bin", bin_of(F.col(column), low, high, bins)).withColumn("bins", one_hot(F.col("bin"), bins))


def orbits3(edges: DataFrame) -> DataFrame:
    """(id, edge, wedge_end, wedge_mid, triangle): how often each vertex holds each place of the connected graphs of two and three vertices."""
    c = clustering(edges)
    d = degrees(edges)
    ends = adjacency(edges).join(d.select(F.col("id").alias("nbr"), F.col("degree").alias("k")), "nbr").groupBy("id").agg(F.sum(F.col("k") - 1).alias("walks"))
    return c.join(ends, "id").select("id", F.col("degree").alias("edge"), (F.col("walks") - 2 * F.col("triangles")).alias("wedge_end"), (F.col("degree") * (F.col("degree") - 1) / 2 - F.col("triangles")).cast("long").alias("wedge_mid"), F.col("triangles").alias("triangle"))


def motif_embedding(edges: DataFrame) -> DataFrame:
    """(id, v): orbit counts as a vector. A pattern that lies in a neighbourhood around its anchor has no larger count, so its violation is 0: a necessary condition that needs no training."""
    o = orbits3(edges)
    return o.select("id", F.array(*(F.col(c).cast("double") for c in ("edge", "wedge_end", "wedge_mid", "triangle"))).alias("v"))




for _name, _build in {"degree": lambda v, e: degrees(e), "clustering": lambda v, e: clustering(e), "pagerank": lambda v, e: pagerank(v, e), "component": lambda v, e: components(v, e), "orbits3": lambda v, e: orbits3(e)}.items():
    register(_name, _build)
