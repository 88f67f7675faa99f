"""Distances, neighbourhoods, components and ranks: frontier joins with cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from graphloom.graph import adjacency  # noqa: F401, read from here too


def _shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set."""
    context = spark.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="graphloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def _cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def _kept(df: DataFrame) -> DataFrame:
    """The same as compressed columns, for large tables: rows of a checkpoint take five times the disk or more."""
    path = f"{_shared(df.sparkSession)}/graphloom_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _listed(batches):
    """Lists of the last column of sorted rows that agree in the others; repeated rows count once. A list ends where its batch does."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        *keys, to = batch.columns
        heads, new = np.ones((2, batch.num_rows), bool)
        heads[1:] = np.any([pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in keys], axis=0)
        new[1:] = heads[1:] | pc.not_equal(to[1:], to[:-1]).to_numpy(zero_copy_only=False)
        new[0] = [c[0] for c in batch.columns] != last
        last = [c[-1] for c in batch.columns]
        kept = np.flatnonzero(new)
        starts = np.flatnonzero(np.diff(np.cumsum(heads)[kept], prepend=0))
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(kept)).astype(np.int32)), to.take(pa.array(kept)))
        yield pa.RecordBatch.from_arrays([*(c.take(pa.array(kept[starts])) for c in keys), lists], names=batch.schema.names)


def bucketed_lists(arcs: DataFrame) -> DataFrame:
    """Arcs (at, ..., to) without repeats as lists (at, ..., to array), in a table of the shared folder that is bucketed by at: what meets them by at moves to them, they are dealt once.

    Rows are sorted in a task and cut into lists as they stream past, so a hub has several lists and none is longer than a batch.
    """
    spark = arcs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    *keys, to = arcs.schema.fields
    schema = StructType([*keys, StructField(to.name, ArrayType(to.dataType))])
    name = f"graphloom_{uuid.uuid4().hex}"
    lists = arcs.repartition(n, "at").sortWithinPartitions(*arcs.columns).mapInArrow(_listed, schema)
    lists.write.bucketBy(n, "at").option("compression", "zstd").option("path", f"{_shared(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def neighbour_lists(edges: DataFrame) -> DataFrame:
    """Neighbours whatever an edge's direction, (at, to array), as bucketed_lists(); edges may repeat."""
    e = edges.where("src <> dst")
    return bucketed_lists(e.select(F.col("src").alias("at"), F.col("dst").alias("to")).unionAll(e.select("dst", "src")))


def degrees_and_walks(lists: DataFrame) -> DataFrame:
    """(id, degree, walks) of neighbour_lists(): a vertex's neighbours and the walks of two steps from it that don't turn back."""
    own = _cut(lists.groupBy("at").agg(F.sum(F.size("to")).alias("degree")))
    sent = lists.join(own.hint("shuffle_hash"), "at").select(F.explode("to").alias("at"), (F.col("degree") - 1).alias("k")).groupBy("at").agg(F.sum("k").alias("walks"))
    return _cut(own.join(sent, "at").select(F.col("at").alias("id"), "degree", "walks"))


def _first_met(batches):
    """(seed, id, depth) of rows (seed, depth, to) sorted by seed and depth: each vertex once, where it is met first."""
    seed = have = None
    for batch in batches:
        n = batch.num_rows
        seeds, depths = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("seed", "depth"))
        to = batch.column("to")
        flat = to.flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(to.value_lengths().to_numpy(zero_copy_only=False))])
        starts = np.flatnonzero(np.concatenate([[True], (seeds[1:] != seeds[:-1]) | (depths[1:] != depths[:-1])])) if n else []
        out = []
        for lo, hi in zip(starts, [*starts[1:], n], strict=True):
            new = np.unique(flat[ends[lo] : ends[hi]])
            if have is None or seeds[lo] != seed:
                seed, have = seeds[lo], new[:0]
            if len(have) and len(new):
                new = new[have[np.minimum(np.searchsorted(have, new), len(have) - 1)] != new]
            if len(new):
                have = np.sort(np.concatenate([have, new]))
                out.append((seed, depths[lo], new))
        if out:
            sizes = [len(x) for *_, x in out]
            yield pa.RecordBatch.from_pydict({"seed": np.repeat([x[0] for x in out], sizes), "id": np.concatenate([x[2] for x in out]), "depth": np.repeat(np.array([x[1] for x in out], np.int32), sizes)})


#: Seeds of a task of khop() on the average, at most.
SEEDS = 1_024


def khop(edges: DataFrame, seeds: DataFrame, cutoff: int, both_ways: bool = True) -> DataFrame:
    """(seed, id, depth): shortest distances from each seed (column id) up to cutoff; edges may repeat.

    A round sends the newest layer to the lists of neighbours, which are dealt once, and these lists to their seeds: what crosses is a list for each vertex of a layer. The last layer,
    the largest by far, is never a row before it is returned: a seed's lists meet in one task, which keeps one ball at a time.
    """
    lists = neighbour_lists(edges) if both_ways else bucketed_lists(edges.where("src <> dst").select(F.col("src").alias("at"), F.col("dst").alias("to")))
    layer = known = seeds.select(F.col("id").alias("seed"), "id").distinct()
    parts = [known.select("seed", F.lit(0).alias("depth"), F.array("id").alias("to"))]
    for depth in range(1, cutoff + 1):
        sent = lists.join(layer.withColumnRenamed("id", "at").hint("shuffle_hash"), "at").select("seed", F.lit(depth).alias("depth"), "to")
        if depth < cutoff:
            sent = _cut(sent)
            layer = _cut(sent.select("seed", F.explode("to").alias("id")).distinct().join(known, ["seed", "id"], "left_anti"))
            known = known.unionByName(layer)
        parts.append(sent)
    n = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-seeds.count() // SEEDS))
    met = reduce(DataFrame.unionByName, parts).repartition(n, "seed").sortWithinPartitions("seed", "depth")
    kind = known.schema["id"].dataType
    return met.mapInArrow(_first_met, StructType([StructField("seed", kind), StructField("id", kind), StructField("depth", IntegerType())]))


def bfs_ball(edges: DataFrame, seeds: DataFrame, radius: int, most: int | None = None, lists: DataFrame | None = None) -> DataFrame:
    """(seed, id, depth) of each seed's neighbourhood: nearest vertices first, ties by id, `most` at most. Each layer is cut to what a ball still takes before the next one grows, so a hub is opened once, never its neighbours' neighbours. lists: neighbour_lists(), if there are some."""
    if most is None:
        return khop(edges, seeds, radius)
    lists = neighbour_lists(edges) if lists is None else lists
    known = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth"))
    layer, room = known, seeds.select(F.col("id").alias("seed"), F.lit(most - 1).cast("long").alias("room"))
    for depth in range(1, radius + 1):
        open_ = layer.join(room.where("room > 0"), "seed").select("seed", "room", F.col("id").alias("at"))
        found = lists.join(open_.hint("shuffle_hash"), "at").select("seed", "room", F.explode("to").alias("id")).distinct()
        rank = F.row_number().over(Window.partitionBy("seed").orderBy("id"))
        cut = found.join(known.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("r", rank).where("r <= room")
        layer = _cut(cut.select("seed", "id", F.lit(depth).alias("depth")))
        known = known.unionByName(layer)
        room = known.groupBy("seed").agg((F.lit(most) - F.count("*")).alias("room"))
    return known


def neighborhood_edges(edges: DataFrame, balls: DataFrame) -> DataFrame:
    """(seed, src, dst, type) induced by each ball."""
    b = balls.select("seed", "id")
    half = edges.where("src <> dst").join(b.withColumnRenamed("id", "src"), "src")
    return half.join(b.withColumnRenamed("id", "dst"), ["seed", "dst"], "left_semi").select("seed", "src", "dst", "type")


def non_isolated(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.where("src <> dst").select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return vertices.join(ends, "id", "left_semi")


def seed_sample(vertices: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n vertices by hash order: the same on every cluster."""
    return vertices.select("id").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "id")), "id").limit(n)


def pairs_of(edges: DataFrame) -> DataFrame:
    """(src, dst) with src < dst: each pair of joined vertices once, directions and loops dropped."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("src").alias("id"), F.col("dst").alias("nbr")).union(pairs.select("dst", "src"))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable, directions ignored.

    Each round, a vertex hooks onto the neighbour of least hash if that is less than its own; the graph is contracted
    along the hooks and goes on with the few that are left. Joins are on vertices, with one row a vertex on one side; a hub's
    neighbours are a pre-aggregated minimum. A dense graph takes two or three rounds, a path a logarithm of its length.
    """
    left, hooks = _cut(pairs_of(edges)), []
    while not left.isEmpty():
        arcs = _both(left)
        low = arcs.groupBy("id").agg(F.min_by("nbr", F.xxhash64("nbr")).alias("near"))
        less = (F.xxhash64("near") < F.xxhash64("id")) | ((F.xxhash64("near") == F.xxhash64("id")) & (F.col("near") < F.col("id")))
        hook = _cut(low.select("id", F.when(less, F.col("near")).otherwise(F.col("id")).alias("up")))
        hooks.append(hook)
        ends = left.join(hook.select(F.col("id").alias("src"), F.col("up").alias("a")), "src").join(hook.select(F.col("id").alias("dst"), F.col("up").alias("b")), "dst")
        left = _cut(pairs_of(ends.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    if not hooks:
        return vertices.select("id", F.col("id").alias("component"))
    tops = hooks[-1].select("id", F.col("up").alias("root"))
    for hook in reversed(hooks[:-1]):
        tops = hook.join(tops.select(F.col("id").alias("up"), "root"), "up", "left").select("id", F.coalesce("root", "up").alias("root"))
    tops = _cut(tops)
    least = tops.groupBy("root").agg(F.min("id").alias("component"))
    found = tops.join(least, "root").select("id", "component")
    return vertices.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def largest_component(parts: DataFrame) -> DataFrame:
    """Ids of the largest component; ties to the least label."""
    size = parts.groupBy("component").agg(F.count("*").alias("n"))
    best = size.orderBy(F.desc("n"), "component").limit(1)
    return parts.join(best.select("component"), "component", "left_semi").select("id")


def pagerank(vertices: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(id, rank) after a fixed number of rounds; rank of vertices without out-edges is spread over all.

    Arcs are dealt once, as lists by source; a round moves ranks to them and one row an arc, or fewer, to the targets.
    """
    lists = bucketed_lists(edges.where("src <> dst").select(F.col("src").alias("at"), F.col("dst").alias("to")))
    n = vertices.count()
    own = _cut(vertices.select("id").join(lists.groupBy(F.col("at").alias("id")).agg(F.sum(F.size("to")).alias("k")), "id", "left"))
    rank = own.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        part = rank.where("k is not null").select(F.col("id").alias("at"), (F.col("rank") / F.col("k")).alias("part"))
        sent = lists.join(part.hint("shuffle_hash"), "at").select(F.explode("to").alias("id"), "part").groupBy("id").agg(F.sum("part").alias("got"))
        lost = rank.where("k is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        # one row is broadcast; a round reads its predecessor twice, so each is cut
        rank = _cut(own.join(sent, "id", "left").crossJoin(F.broadcast(lost)).select("id", "k", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank")))
    return rank.select("id", "rank")


def oriented(edges: DataFrame, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(u, v, du, dv) of each pair from lower to higher degree with its ends' degrees, so that hubs open few wedges, and (id, degree). Both are written once and read by all that follows. pairs: pairs_of(edges), if they are written."""
    pairs = _kept(pairs_of(edges)) if pairs is None else pairs
    deg = _cut(_both(pairs).groupBy("id").agg(F.count("*").alias("degree")))
    at = pairs.join(deg.select(F.col("id").alias("src"), F.col("degree").alias("d")), "src").join(deg.select(F.col("id").alias("dst"), F.col("degree").alias("e")), "dst")
    up = F.col("d") <= F.col("e")  # src < dst breaks ties
    return _kept(at.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("v"), F.least("d", "e").alias("du"), F.greatest("d", "e").alias("dv"))), deg


#: Arcs of a block of closed() at most on the average, and its blocks and splits of each at least.
BLOCK, BLOCKS, SPLITS = 1 << 25, 4, 4


def _meet(batches):
    """(u, v, thirds) of rows (cell, kind, u, to) by cell, lists of a block first."""
    cell, held, keys = None, [], None
    for batch in batches:
        at, kinds, us = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "kind", "u"))
        to = batch.column("to")
        flat, size = to.flatten().to_numpy(zero_copy_only=False), to.value_lengths().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(size)])
        out = ([], [], [], [])
        cuts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (kinds[1:] != kinds[:-1])])) if len(at) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(at)], strict=True):
            if at[lo] != cell:
                cell, held, keys = at[lo], [], None
            if kinds[lo] == 0:
                held.append((us[lo:hi], size[lo:hi], flat[ends[lo] : ends[hi]]))
                continue
            if not held:
                continue
            if keys is None:
                key, length, on = (np.concatenate([h[k] for h in held]) for k in range(3))
                held, order, first = [True], np.argsort(key), np.cumsum(length) - length
                keys, starts, lengths = key[order], first[order], length[order]
            asked = flat[ends[lo] : ends[hi]]
            near = keys[np.minimum(np.searchsorted(keys, asked), len(keys) - 1)] == asked
            # most lists of a graph with few triangles lead to no list of the block
            for r in lo + np.unique(np.searchsorted(ends[lo + 1 : hi + 1] - ends[lo], np.flatnonzero(near), side="right")):
                mine = flat[ends[r] : ends[r + 1]]
                k = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                there = keys[k] == mine
                k, v = k[there], mine[there]
                n = lengths[k]
                w = on[np.repeat(starts[k] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                hit = mine[np.minimum(np.searchsorted(mine, w), len(mine) - 1)] == w
                if hit.any():
                    of = np.repeat(np.arange(len(v)), n)[hit]
                    many = np.bincount(of, minlength=len(v))
                    some = many > 0
                    out[0].append(np.full(some.sum(), us[r]))
                    out[1].append(v[some])
                    out[2].append(many[some])
                    out[3].append(w[hit])
        if out[0]:
            u, v, many, w = (np.concatenate(x) for x in out)
            thirds = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(w))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), thirds], ["u", "v", "thirds"])


def closed(arcs: DataFrame) -> DataFrame:
    """(u, v, thirds array<long>) of each arc of oriented() that closes triangles: the vertices that u and v both lead to.

    A vertex leads to at most the root of twice the edges, so its list is short even at a hub. Vertices are dealt into a few blocks; a list goes once to each block it leads to, not once an arc,
    and meets the lists of the block there. A task holds the lists of one block; rows that ask stream past it.
    """
    lists = _kept(arcs.groupBy("u").agg(F.array_sort(F.collect_list("v")).alias("to")))
    # a list is copied to each block that it leads to and to each split of its own
    blocks = max(BLOCKS, -(-arcs.count() // BLOCK))
    splits = max(3, -(-BLOCKS * SPLITS // blocks))
    block = lambda x: F.pmod(F.xxhash64(x), F.lit(blocks)).cast("int")
    held = lists.select(F.explode(F.sequence(block(F.col("u")) * splits, block(F.col("u")) * splits + splits - 1)).alias("cell"), F.lit(0).alias("kind"), "u", "to")
    split = F.pmod(F.xxhash64("u", F.lit(1)), F.lit(splits)).cast("int")
    asks = lists.where(F.size("to") > 1).select(F.explode(F.array_distinct(F.transform("to", block))).alias("cell"), "u", "to").select((F.col("cell") * splits + split).alias("cell"), F.lit(1).alias("kind"), "u", "to")
    dealt = held.unionAll(asks).repartition(blocks * splits, "cell").sortWithinPartitions("cell", "kind")
    return dealt.mapInArrow(_meet, "u long, v long, thirds array<long>")


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) of an undirected graph, a < b < c."""
    low, high = F.least("u", "v", "w"), F.greatest("u", "v", "w")
    return closed(oriented(edges)[0]).select("u", "v", F.explode("thirds").alias("w")).select(low.alias("a"), (F.col("u") + F.col("v") + F.col("w") - low - high).alias("b"), high.alias("c"))


def triangle_total(edges: DataFrame) -> DataFrame:
    """n: how many triangles, without a row for each."""
    return closed(oriented(edges)[0]).agg(F.coalesce(F.sum(F.size("thirds").cast("long")), F.lit(0)).alias("n"))


def corner_counts(met: DataFrame) -> DataFrame:
    """(id, triangles) of rows of closed()."""
    size = F.size("thirds").cast("long")
    one = lambda v, k: F.struct(v.alias("id"), k.alias("k"))
    corners = F.concat(F.array(one(F.col("u"), size), one(F.col("v"), size)), F.transform("thirds", lambda w: one(w, F.lit(1).cast("long"))))
    return met.select(F.explode(corners).alias("c")).groupBy("c.id").agg(F.sum("c.k").alias("triangles"))


def edge_support(edges: DataFrame) -> DataFrame:
    """(src, dst, common) with src < dst of each edge in a triangle: how many neighbours its ends share."""
    return support_of(closed(oriented(edges)[0]))


def support_of(met: DataFrame) -> DataFrame:
    """edge_support() of rows of closed()."""
    pair = lambda a, b: (F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))
    own = met.select(*pair("u", "v"), F.size("thirds").cast("long").alias("k"))
    third = met.select("u", "v", F.explode("thirds").alias("w"))
    one = F.lit(1).cast("long").alias("k")
    return own.unionAll(third.select(*pair("u", "w"), one)).unionAll(third.select(*pair("v", "w"), one)).groupBy("src", "dst").agg(F.sum("k").alias("common"))


def clustering(edges: DataFrame) -> DataFrame:
    """(id, degree, triangles, clustering) of vertices with a neighbour."""
    arcs, d = oriented(edges)
    t = corner_counts(closed(arcs))
    n = F.coalesce("triangles", F.lit(0))
    return d.join(t, "id", "left").select("id", "degree", n.alias("triangles"), F.when(F.col("degree") > 1, 2.0 * n / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0).alias("clustering"))
