"""Search, encoders and generated training data. Stochastic or numeric: no SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.models import encoder as N
from graphloom.models import learn as L
from graphloom.models import training as G
from graphloom.operators import canon as C
from graphloom.operators import sample as P
from graphloom.operators import search as S
from graphloom.operators import traverse as T
from graphloom.plans.views import SQL_ADJ, SQL_COP, cop_edges, cop_vertices, table
from graphloom.queries.registry import query

SPEC = S.MineSpec()


def _store(spark, sf, spec=SPEC):
    v, e = cop_vertices(spark, sf), cop_edges(spark, sf)
    balls = T.bfs_ball(e, T.seed_sample(T.non_isolated(v, e), spec.n_neighborhoods, spec.seed), spec.radius, spec.neighborhood_size)
    return S.store(balls, T.neighborhood_edges(e, balls), v, spec)


for _agent in ("greedy", "beam", "mcts"):
    query(f"{_agent}_mine")(lambda spark, sf, agent=_agent: S.mine(spark, _store(spark, sf), SPEC, agent))


def _ball_graphs(spark, sf):
    """The neighbourhoods of parts with an id divisible by 20, as arrays with places for ids; the seed is the anchor."""
    v, e = cop_vertices(spark, sf), cop_edges(spark, sf)
    ball = T.bfs_ball(e, v.where("id % 20 = 0").select("id"), 2, 30)
    place = ball.withColumn("at", F.row_number().over(Window.partitionBy("seed").orderBy("depth", "id")) - 1)
    inner = T.neighborhood_edges(e, ball)
    for end, name in (("src", "x"), ("dst", "y")):
        inner = inner.join(place.select("seed", F.col("id").alias(end), F.col("at").alias(name)), ["seed", end])
    arcs = inner.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("e"))  # 30 vertices at most
    labels = place.join(v, "id").groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("at", F.regexp_extract("label", r"(\d+)$", 1).cast("int").alias("l")))).alias("v"))
    none = F.array().cast("array<struct<x:int,y:int>>")
    g = labels.join(arcs, "seed", "left").withColumn("e", F.coalesce("e", none))
    return g.select(F.col("seed").alias("id"), F.col("v.l").alias("labels"), F.col("e.x").alias("src"), F.col("e.y").alias("dst"), F.transform("e", lambda x: (x["x"] + x["y"]) % 4).alias("types"), F.lit(0).alias("anchor"))


@query("gnn_embed")
def gnn_embed(spark, sf):
    """Neighbourhoods of the co-purchase graph by an encoder that is trained on pairs from such neighbourhoods, with their labels and anchors."""
    spec = N.EncoderSpec(conv="sage", layers=3, hidden=32)
    v = cop_vertices(spark, sf).withColumn("label_id", F.regexp_extract("label", r"(\d+)$", 1).cast("int"))
    L.train(L.pair_rows(G.source("node-balanced", spark, 400, vertices=v, edges=cop_edges(spark, sf)), 400), spec, 8, margin=1.0)
    return N.embed(_ball_graphs(spark, sf), spec)


@query("rgcn_embed")
def rgcn_embed(spark, sf):
    return N.embed(_ball_graphs(spark, sf), N.EncoderSpec(conv="rgcn", layers=2))


@query("text_projection")
def text_projection(spark, sf):
    return L.Projection.random().frame(N.text_vectors(table(spark, sf, "part").select(F.col("p_brand").alias("label"))))


@query("random_tree_sets")
def random_tree_sets(spark, sf):
    v, e = cop_vertices(spark, sf), cop_edges(spark, sf)
    return P.random_trees(e, P.trials(v, 100, 3, 6))


@query("sampled_motifs")
def sampled_motifs(spark, sf):
    return P.sampled_motifs(cop_vertices(spark, sf), cop_edges(spark, sf), 4, 300)


@query("baseline_queries")
def baseline_queries(spark, sf):
    sizes = spark.createDataFrame([(k, 3 + k % 4) for k in range(12)], "pattern int, size int")
    v, e = cop_vertices(spark, sf), cop_edges(spark, sf, repeats=True)
    lists = T.neighbour_lists(e)  # read by both kinds
    made = [P.baseline_queries(v, e, sizes, kind, lists=lists).withColumn("kind", F.lit(kind)) for kind in ("tree", "radial")]
    return made[0].unionByName(made[1])


@query("hub_starts", f"""WITH {SQL_COP}, {SQL_ADJ}, d AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY md5('42:' || p_partkey), p_partkey) AS k FROM part QUALIFY k <= 50), two AS (SELECT id, id AS at FROM d UNION SELECT d.id, nbr FROM d JOIN adj USING (id) UNION SELECT d.id, y.nbr FROM d JOIN adj x USING (id) JOIN adj y ON y.id = x.nbr),
r AS (SELECT id, count(*) AS reach FROM two GROUP BY id) SELECT k % 5 AS trial, arg_max(id, (reach, -id)) AS id, max(reach) AS reach FROM d JOIN r USING (id) GROUP BY trial""")
def hub_starts(spark, sf):
    return P.hub_starts(cop_vertices(spark, sf), cop_edges(spark, sf), 5)


@query("mined_classes")
def mined_classes(spark, sf):
    """Sampled sets of three and four vertices as labelled graphs, split by exact isomorphism."""
    v, e = cop_vertices(spark, sf), cop_edges(spark, sf)
    grown = P.random_trees(e, P.trials(v, 200, 3, 4))
    place = grown.join(v, "id").withColumn("at", F.row_number().over(Window.partitionBy("trial").orderBy("id")) - 1)
    arcs = T.neighborhood_edges(e, grown.withColumnRenamed("trial", "seed")).withColumnRenamed("seed", "trial")
    for end, name in (("src", "x"), ("dst", "y")):
        arcs = arcs.join(place.select("trial", F.col("id").alias(end), F.col("at").alias(name)), ["trial", end])
    arcs = arcs.groupBy("trial").agg(F.array_sort(F.collect_list(F.struct(F.col("x").alias("src"), F.col("y").alias("dst"), F.lit("").alias("type")))).alias("arcs"))
    labels = place.groupBy("trial").agg(F.array_sort(F.collect_list(F.struct("at", "label"))).alias("v")).select("trial", F.col("v.label").alias("labels"))
    i = labels.join(arcs, "trial").withColumn("hash", F.md5(F.concat_ws(",", F.array_sort("labels"), F.size("arcs").cast("string"))))
    return C.classes(i)


@query("hash_text_vectors")
def hash_text_vectors(spark, sf):
    return N.text_vectors(table(spark, sf, "part").select(F.col("p_brand").alias("label")))


def _neighbourhoods(spark, sf):
    """Small graphs of the parts with an id divisible by 20: (graph_id, n, edges, labels)."""
    v = cop_vertices(spark, sf)
    return G.pairs_from_graph(v, cop_edges(spark, sf), 0, seeds=v.where("id % 20 = 0").select("id"))


@query("synth_graphs")
def synth_graphs(spark, sf):
    """A random graph of a drawn kind for each neighbourhood, of its size."""
    return G.synthetic_graphs(spark, 0, sizes=_neighbourhoods(spark, sf)).select("graph_id", "kind", "n", F.size("edges").alias("m"))


@query("planted_graphs")
def planted_graphs(spark, sf):
    """The same with a fixed pattern planted into each."""
    return G.synthetic_graphs(spark, 0, planted=True, sizes=_neighbourhoods(spark, sf)).select("graph_id", "kind", "n", F.size("edges").alias("m"))


@query("pair_batches")
def pair_batches(spark, sf):
    """A labelled pair from each neighbourhood: half of them verified near misses."""
    return G.pair_batches(_neighbourhoods(spark, sf)).select("pair_id", "label", "kind", F.size("a").alias("m_a"), F.size("b").alias("m_b"))


@query("imbalanced_pairs")
def imbalanced_pairs(spark, sf):
    """A pair drawn from each neighbourhood, with the label that an exact search gives it."""
    return G.pair_batches(_neighbourhoods(spark, sf), balanced=False).select("pair_id", "label", "kind", F.size("a").alias("m_a"), F.size("b").alias("m_b"))


@query("graph_pairs")
def graph_pairs(spark, sf):
    """The single-graph source over the co-purchase graph."""
    return G.source("node-balanced", spark, 100, vertices=cop_vertices(spark, sf), edges=cop_edges(spark, sf)).select("pair_id", "label", "kind", F.size("a").alias("m_a"), F.size("b").alias("m_b"))
