"""Embedding near-dedup by collision counting over sorted one-dimensional projections."""

from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import components, smallest, stage

COSINE = 0.9
PROJECTIONS = 32
#: Half a window's width, in standard deviations of what a pair at the wanted cosine is apart on a projection.
WINDOW = 2.0
#: The share of pairs at exactly the wanted cosine that the count must let through.
RECALL = 0.995
#: Distinct vectors in a block, on average.
BLOCK = 4096
TILE = 256


def least_count(m: int = PROJECTIONS, window: float = WINDOW, recall: float = RECALL) -> int:
    """The largest count of collisions that a pair at the wanted cosine reaches with the chance `recall`: its differences on independent Gaussian projections are normal, so its count is binomial."""
    p = erf(window / sqrt(2))
    tail = 0.0
    for count in range(m, -1, -1):
        tail += comb(m, count) * p**count * (1 - p) ** (m - count)
        if tail >= recall:
            return count
    return 0


def _unpacked(part: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, how many vectors are equal to each, and unit vectors in double precision."""
    ids, many = np.frombuffer(part["ids"], np.int64), np.frombuffer(part["many"], np.int64)
    v = np.frombuffer(part["vectors"], np.float64).reshape(len(ids), -1)
    v = v / np.abs(v).max(1, keepdims=True)
    return ids, many, v / np.sqrt((v * v).sum(1, keepdims=True))


def links_between(q: np.ndarray, d: np.ndarray, cosine: float = COSINE, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of unit vectors q[i], d[j] with at least the wanted cosine, of those that collide often enough.

    Each projection of d is sorted; a query's window on it is a run of ranks, found by two searches. The pair
    collides there if the rank lies in the run. Counts are kept for TILE queries against all of d; pairs with
    least_count() or more are verified in double precision.
    """
    axes = np.random.default_rng(seed).normal(size=(q.shape[1], PROJECTIONS))
    half, least = WINDOW * sqrt(2 - 2 * cosine), least_count()
    on_q, on_d = q @ axes, d @ axes
    ranks = np.empty((PROJECTIONS, len(d)), np.uint16)
    low, width = np.empty((PROJECTIONS, len(q)), np.uint16), np.empty((PROJECTIONS, len(q)), np.uint16)
    for k in range(PROJECTIONS):
        order = np.argsort(on_d[:, k], kind="stable")
        ranks[k, order] = np.arange(len(d))
        line = on_d[order, k]
        a, b = np.searchsorted(line, on_q[:, k] - half, "left"), np.searchsorted(line, on_q[:, k] + half, "right")
        low[k], width[k] = a, b - a
    found_i, found_j = [], []
    for at in range(0, len(q), TILE):
        end = min(len(q), at + TILE)
        count = np.zeros((end - at, len(d)), np.uint8)
        for k in range(PROJECTIONS):
            count += (ranks[k] - low[k, at:end, None]) < width[k, at:end, None]  # below the run wraps round to a large number
        i, j = np.nonzero(count >= least)
        near = np.ones(len(i), bool)
        exact = np.arange(len(i))
        if len(i) > 0.02 * count.size:  # a product tells all but pairs at the very edge, which the one exact sum decides as ever
            dot = (q[at:end] @ d.T)[i, j]
            near, exact = dot >= cosine, np.flatnonzero(np.abs(dot - cosine) < 1e-9)
        for c in range(0, len(exact), 16384):
            z = exact[c : c + 16384]
            near[z] = np.einsum("ij,ij->i", q[at + i[z]], d[j[z]]) >= cosine
        found_i.append(at + i[near])
        found_j.append(j[near])
    return np.concatenate(found_i), np.concatenate(found_j)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each node's component in a graph of nodes 0..n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _compare(parts: list[dict], cosine: float) -> pa.Table:
    """One or two blocks: for each of their vectors that has links here, how many vectors it links with and one edge to its least component member here."""
    if not parts:
        return pa.table({"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "to": pa.array([], pa.int64())})
    ids, many, q = _unpacked(parts[0])
    if len(parts) == 1:
        i, j = links_between(q, q, cosine)
        i, j = i[i != j], j[i != j]
        links = np.bincount(i, many[j], len(ids))
        all_ids, a, b = ids, i, j
    else:
        ids2, many2, d = _unpacked(parts[1])
        i, j = links_between(q, d, cosine)
        links = np.concatenate([np.bincount(i, many2[j], len(ids)), np.bincount(j, many[i], len(ids2))])
        all_ids, a, b = np.concatenate([ids, ids2]), i, j + len(ids)
    order = np.argsort(all_ids)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    root = forest(rank[a], rank[b], len(order))
    some = np.flatnonzero(links)
    return pa.table({"rep": all_ids[some], "links": np.rint(links[some]).astype(np.int64), "to": all_ids[order[root[rank[some]]]]})


def near_vectors(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """One row a vector: vec_id, n_links (other vectors at the wanted cosine or more), component_id (the least vec_id that links reach), kept (it is that one).

    Equal vectors are one before anything is compared, and count in n_links. Distinct vectors are dealt into
    blocks of bounded size by a hash; each pair of blocks is one group of two rows, in which collisions are counted in
    tiles. A group gives back a count and one edge a vector, never its pairs, so dense groups of near copies send on no more than sparse
    ones. The number of pairs of blocks grows with the square of the distinct vectors: projections of a line can't
    rule more out without losing links.

    A null vector, or one of zeros or with null or non-finite components, links with nothing, and vectors of different
    lengths don't either; a null vec_id has no links and a null component; repeated rows are one vector, and of different vectors of one vec_id the
    one of least hash counts; other columns are ignored. An empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumns({"sound": F.coalesce(sound, F.lit(False)), "k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(5), "v")})
    # one vector an id: of several the one of least hash, however the rows come in; vectors without an id stay apart
    rows = rows.groupBy("vec_id", F.when(F.col("vec_id").isNull(), F.col("k1")).alias("loose")).agg(F.min_by(F.struct("v", "sound", "k1", "k2"), F.struct("k1", "k2")).alias("row"))
    rows = stage(rows.select("vec_id", "row.*"))
    equal = stage(rows.where("sound").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many")))
    first = rows.where("sound").join(equal, ["k1", "k2"]).where("vec_id = rep").dropDuplicates(["rep"]).select("rep", "many", "v")
    n_blocks = max(1, -(-equal.count() // block))

    def pack(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"dim": pa.array([], pa.int32()), "block": pa.array([], pa.int64()), "ids": pa.array([], pa.binary()), "many": pa.array([], pa.binary()), "vectors": pa.array([], pa.binary())})
        table = table.sort_by("rep").combine_chunks()
        flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        own = lambda name: table[name].to_numpy().astype(np.int64).tobytes()
        return pa.table({"dim": pa.array([table["dim"][0].as_py()], pa.int32()), "block": pa.array([table["block"][0].as_py()], pa.int64()), "ids": [own("rep")], "many": [own("many")], "vectors": [flat.tobytes()]})

    dealt = first.select("rep", "many", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("rep"), F.lit(n_blocks)).alias("block"))
    blocks = stage(dealt.groupBy("dim", "block").applyInArrow(pack, "dim int, block bigint, ids binary, many binary, vectors binary"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))
    pairs = blocks.withColumn("other", other).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other")

    def compare(table: pa.Table) -> pa.Table:
        parts = table.select(["block", "ids", "many", "vectors"]).to_pylist()
        if len(parts) == 1 and table["lo"][0].as_py() != table["hi"][0].as_py():
            parts = []  # the other block is empty
        return _compare(parts, cosine)

    told = stage(pairs.groupBy("dim", "lo", "hi").applyInArrow(compare, "rep bigint, links bigint, to bigint"))
    links = told.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = smallest(components(told.where("rep <> to"), "rep", "to"))
    out = rows.select("vec_id", "sound", "k1", "k2").join(equal, ["k1", "k2"], "left").withColumn("rep", F.when(F.col("sound"), F.col("rep")))
    out = out.join(links, "rep", "left").join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left")
    n_links = F.when(F.col("rep").isNotNull(), F.coalesce("links", F.lit(0)) + F.col("many") - 1).otherwise(0).cast("long")
    component = F.when(F.col("rep").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


#: SQL for near_vectors over the table embeddings.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v WHERE e IS NOT NULL),
pair AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0
    AND list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) / (a.n * b.n) >= 0.9),
reach(a, b) AS (SELECT a, b FROM pair UNION SELECT r.a, p.b FROM reach r JOIN pair p ON r.b = p.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS k FROM pair GROUP BY a)
SELECT v.vec_id, coalesce(n.k, 0) AS n_links, least(v.vec_id, coalesce(low.m, v.vec_id)) AS component_id,
  v.vec_id = least(v.vec_id, coalesce(low.m, v.vec_id)) AS kept
FROM v LEFT JOIN n ON v.vec_id = n.a LEFT JOIN low ON v.vec_id = low.a
"""
