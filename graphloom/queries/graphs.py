"""Views, traversal and graph analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import scalar as S
from graphloom.graph import PropertyGraph, adjacency, induced_edges, non_edges
from graphloom.operators import enumerate as E
from graphloom.operators import features as X
from graphloom.operators import traverse as T
from graphloom.operators.orderemb import dominance
from graphloom.operators.report import graph_context
from graphloom.plans.views import SQL_ADJ, SQL_COP, SQL_SADJ, SQL_SE, SQL_SV, TAG, cop_edges, cop_vertices, star_edges, star_vertices, table
from graphloom.queries.registry import query

query("star_vertices", f"WITH {SQL_SV} SELECT * FROM sv")(star_vertices)
query("star_edges", f"WITH {SQL_SE} SELECT * FROM se")(star_edges)


@query("undirected_adj", f"WITH {SQL_SE}, {SQL_SADJ} SELECT id, count(*) AS n FROM sadj GROUP BY id")
def undirected_adj(spark, sf):
    return adjacency(star_edges(spark, sf)).groupBy("id").agg(F.count("*").alias("n"))


@query("undirected_graph", f"WITH {SQL_SE} SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM se WHERE src <> dst")
def undirected_graph(spark, sf):
    return PropertyGraph(star_vertices(spark, sf), star_edges(spark, sf)).undirected().edges.select("src", "dst")


@query("graph_context", f"WITH {SQL_SV}, {SQL_SE} SELECT n_nodes, n_edges, n_labels, n_types, 2.0::DOUBLE * n_edges / n_nodes AS avg_degree FROM (SELECT count(*) AS n_nodes, count(DISTINCT label) AS n_labels FROM sv), (SELECT count(*) AS n_edges, count(DISTINCT type) AS n_types FROM se)")
def context(spark, sf):
    return graph_context(star_vertices(spark, sf), star_edges(spark, sf))


@query("graph_stats", f"WITH {SQL_COP}, {SQL_ADJ}, d AS (SELECT id, count(*) AS k FROM adj GROUP BY id), n AS (SELECT count(*) AS n FROM part) SELECT n, CAST(sum(k) / 2 AS BIGINT) AS m, max(k) AS max_degree, round(2.0::DOUBLE * CAST(sum(k) / 2 AS BIGINT) / n, 6) AS avg_degree FROM d, n GROUP BY n")
def stats(spark, sf):
    v, e = cop_vertices(spark, sf), cop_edges(spark, sf)
    return X.graph_stats(v, e).select("n", "m", "max_degree", F.round("avg_degree", 6).alias("avg_degree"))


@query("degree_sequence", f"WITH {SQL_COP}, {SQL_ADJ}, d AS (SELECT id, count(*) AS degree FROM adj GROUP BY id) SELECT degree, count(*) AS n FROM d GROUP BY degree")
def degree_sequence(spark, sf):
    return X.degree_sequence(cop_edges(spark, sf))


@query("degree_bucket", f"WITH {SQL_COP}, {SQL_ADJ}, d AS (SELECT id, count(*) AS degree FROM adj GROUP BY id), q AS (SELECT quantile_cont(degree, 0.35) AS q1, quantile_cont(degree, 0.75) AS q2 FROM d) SELECT id, degree, CASE WHEN degree >= q2 THEN 'high' WHEN degree <= q1 THEN 'low' ELSE 'mid' END AS bucket FROM d, q")
def degree_bucket(spark, sf):
    return X.degree_buckets(cop_edges(spark, sf))


@query("inverse_sqrt_degree", f"WITH {SQL_COP}, {SQL_ADJ} SELECT id, round(pow(count(*), -0.5), 6) AS norm FROM adj GROUP BY id")
def inverse_sqrt_degree(spark, sf):
    return X.inverse_sqrt_degree(cop_edges(spark, sf)).select("id", F.round("norm", 6).alias("norm"))


@query("degree_one_hot", f"WITH {SQL_COP}, {SQL_ADJ}, d AS (SELECT id, count(*) AS k FROM adj GROUP BY id) SELECT id, array_to_string(list_transform(range(0, 16), lambda i: CASE WHEN i = least(k, 15) THEN 1 ELSE 0 END), '') AS bits FROM d")
def degree_one_hot(spark, sf):
    return X.degree_one_hot(cop_edges(spark, sf), 16).select("id", F.array_join(F.col("degree_one_hot").cast("array<string>"), "").alias("bits"))


@query("non_isolated_seeds", f"WITH {SQL_COP}, {SQL_ADJ} SELECT p_partkey AS id, p_brand AS label FROM part WHERE p_partkey IN (SELECT id FROM adj)")
def non_isolated_seeds(spark, sf):
    return T.non_isolated(cop_vertices(spark, sf), cop_edges(spark, sf))


@query("seed_sample", "SELECT p_partkey AS id FROM part ORDER BY md5('42:' || p_partkey), p_partkey LIMIT 100")
def seed_sample(spark, sf):
    return T.seed_sample(cop_vertices(spark, sf), 100)


@query("induced_subgraph", f"WITH {SQL_COP}, k AS (SELECT p_partkey AS id FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')) SELECT src, dst FROM cop WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def induced_subgraph(spark, sf):
    ids = cop_vertices(spark, sf).where(F.col("label").isin("Brand#1", "Brand#2", "Brand#3")).select("id")
    return induced_edges(cop_edges(spark, sf), ids).select("src", "dst")


@query("non_edges", f"WITH {SQL_COP}, k AS (SELECT p_partkey AS id FROM part WHERE p_brand = 'Brand#7') SELECT a.id AS src, b.id AS dst FROM k a JOIN k b ON a.id < b.id WHERE NOT EXISTS (SELECT 1 FROM cop WHERE src = a.id AND dst = b.id)")
def non_edges_query(spark, sf):
    ids = cop_vertices(spark, sf).where("label = 'Brand#7'").select("id")
    return non_edges(ids, induced_edges(cop_edges(spark, sf), ids))


@query("khop_distances", f"WITH RECURSIVE {SQL_COP}, {SQL_ADJ}, h(seed, id, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_partkey % 20 = 0 UNION SELECT h.seed, a.nbr, h.depth + 1 FROM h JOIN adj a ON a.id = h.id WHERE h.depth < 2) SELECT seed, id, min(depth) AS depth FROM h GROUP BY seed, id")
def khop_distances(spark, sf):
    return T.khop(cop_edges(spark, sf, repeats=True), cop_vertices(spark, sf).where("id % 20 = 0").select("id"), 2)


@query("bfs_ball_capped", f"WITH RECURSIVE {SQL_COP}, {SQL_ADJ}, h(seed, id, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_partkey % 20 = 0 UNION SELECT h.seed, a.nbr, h.depth + 1 FROM h JOIN adj a ON a.id = h.id WHERE h.depth < 2), b AS (SELECT seed, id, min(depth) AS depth FROM h GROUP BY seed, id) SELECT seed, id, depth FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, id) AS r FROM b) WHERE r <= 25")
def bfs_ball_capped(spark, sf):
    return T.bfs_ball(cop_edges(spark, sf), cop_vertices(spark, sf).where("id % 20 = 0").select("id"), 2, 25)


@query("neighborhood_edges", f"WITH {SQL_COP}, {SQL_ADJ}, h AS (SELECT p_partkey AS seed, p_partkey AS id FROM part WHERE p_partkey % 20 = 0 UNION SELECT a.id, a.nbr FROM adj a WHERE a.id % 20 = 0) SELECT x.seed, c.src, c.dst FROM cop c JOIN h x ON c.src = x.id JOIN h y ON c.dst = y.id AND x.seed = y.seed")
def neighborhood_edges(spark, sf):
    e = cop_edges(spark, sf)
    return T.neighborhood_edges(e, T.bfs_ball(e, cop_vertices(spark, sf).where("id % 20 = 0").select("id"), 1)).select("seed", "src", "dst")


@query("reaching_seeds", f"WITH RECURSIVE {SQL_COP}, {SQL_ADJ}, h(seed, id, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_partkey % 20 = 0 UNION SELECT h.seed, a.nbr, h.depth + 1 FROM h JOIN adj a ON a.id = h.id WHERE h.depth < 1) SELECT seed AS id, count(DISTINCT id) AS reached FROM h GROUP BY seed HAVING count(DISTINCT id) >= 100")
def reaching_seeds(spark, sf):
    from graphloom.operators.sample import reaching

    return reaching(cop_edges(spark, sf), cop_vertices(spark, sf).where("id % 20 = 0").select("id"), 100, 1)


@query("log_score_votes", "SELECT b.vec_id AS pattern, round(sum(ln(greatest(1 - 1 / (1 + exp(-(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: pow(greatest(z[2]::DOUBLE - z[1]::DOUBLE, 0), 2))) * -4.0 + 4.0))), 1e-12))), 3) AS score FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0 GROUP BY b.vec_id")
def log_score_votes(spark, sf):
    from graphloom.operators.orderemb import log_score_of

    t = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return log_score_of(t.where("id % 20 = 0"), t, -4.0, 4.0).withColumn("score", F.round("score", 3))


@query("dense_relabel", "SELECT n_nationkey AS id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS BIGINT) AS dense, n_regionkey AS graph_id, CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) = 1 THEN 1 ELSE 0 END AS anchor FROM nation")
def dense_relabel(spark, sf):
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), (r - 1).cast("long").alias("dense"), F.col("n_regionkey").alias("graph_id"), F.when(r == 1, 1).otherwise(0).alias("anchor"))


def _parts(adj: str, rounds: int) -> str:
    """Least ids after so many rounds over neighbours: components, if no two vertices of one are farther apart."""
    return ", ".join(["c0 AS (SELECT id, id AS c FROM v)", *(f"c{i} AS MATERIALIZED (SELECT p.id, least(p.c, coalesce(min(q.c), p.c)) AS c FROM c{i - 1} p LEFT JOIN {adj} a ON a.id = p.id LEFT JOIN c{i - 1} q ON q.id = a.nbr GROUP BY p.id, p.c)" for i in range(1, rounds + 1)), f"comp AS (SELECT id, c AS component FROM c{rounds})"])


_COP_PARTS = f"WITH {SQL_COP}, {SQL_ADJ.replace('adj AS', 'adj AS MATERIALIZED')}, v AS (SELECT p_partkey AS id FROM part), {_parts('adj', 8)}"


@query("components", f"{_COP_PARTS} SELECT id, component FROM comp")
def components(spark, sf):
    return T.components(cop_vertices(spark, sf), cop_edges(spark, sf))


@query("components_star", f"WITH {SQL_SV}, {SQL_SE}, {SQL_SADJ.replace('sadj AS', 'sadj AS MATERIALIZED')}, v AS (SELECT id FROM sv), {_parts('sadj', 10)} SELECT id, component FROM comp")
def components_star(spark, sf):
    return T.components(star_vertices(spark, sf), star_edges(spark, sf))


@query("largest_component", f"{_COP_PARTS}, s AS (SELECT component, count(*) AS n FROM comp GROUP BY component ORDER BY n DESC, component LIMIT 1) SELECT id FROM comp WHERE component IN (SELECT component FROM s)")
def largest_component(spark, sf):
    return T.largest_component(T.components(cop_vertices(spark, sf), cop_edges(spark, sf)))


_TRI = "tri AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM cop x JOIN cop y ON x.dst = y.src JOIN cop z ON z.src = x.src AND z.dst = y.dst)"


@query("triangle_count", f"WITH {SQL_COP}, {_TRI} SELECT count(*) AS n FROM tri")
def triangle_count(spark, sf):
    return T.triangle_total(cop_edges(spark, sf))


@query("clustering_coeff", f"WITH {SQL_COP}, {SQL_ADJ}, {_TRI}, t AS (SELECT id, count(*) AS t FROM (SELECT a AS id FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) GROUP BY id), d AS (SELECT id, count(*) AS degree FROM adj GROUP BY id) SELECT d.id, degree, coalesce(t, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2.0::DOUBLE * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END, 6) AS clustering FROM d LEFT JOIN t USING (id)")
def clustering_coeff(spark, sf):
    return T.clustering(cop_edges(spark, sf)).withColumn("clustering", F.round("clustering", 6))


_RANK = ", ".join(f"r{i} AS (SELECT v.id, 0.15 / n.n + 0.85 * (coalesce(g.got, 0) + l.lost / n.n) AS rank FROM v CROSS JOIN n CROSS JOIN (SELECT coalesce(sum(rank), 0) AS lost FROM r{i - 1} WHERE id NOT IN (SELECT src FROM o)) l LEFT JOIN (SELECT e.dst AS id, sum(r.rank / o.k) AS got FROM e JOIN o ON o.src = e.src JOIN r{i - 1} r ON r.id = e.src GROUP BY e.dst) g ON g.id = v.id)" for i in range(1, 6))


@query("pagerank_fixed_iter", f"WITH {SQL_SV}, {SQL_SE}, v AS (SELECT id FROM sv), e AS (SELECT DISTINCT src, dst FROM se WHERE src <> dst), o AS (SELECT src, count(*) AS k FROM e GROUP BY src), n AS (SELECT count(*)::DOUBLE AS n FROM v), r0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM v, n), {_RANK} SELECT id, round(rank, 9) AS rank FROM r5")
def pagerank_fixed_iter(spark, sf):
    return T.pagerank(star_vertices(spark, sf), star_edges(spark, sf, repeats=True), 5).select("id", F.round("rank", 9).alias("rank"))


@query("esu_size3", f"WITH {SQL_COP}, {SQL_ADJ}, {_TRI}, t AS (SELECT count(*) AS t FROM tri), w AS (SELECT CAST(sum(k * (k - 1) / 2) AS BIGINT) AS w FROM (SELECT count(*) AS k FROM adj GROUP BY id)) SELECT '2,2,2' AS degrees, 3 AS m, t AS n FROM t UNION ALL SELECT '1,1,2', 2, w - 3 * t FROM t, w")
def esu_size3(spark, sf):
    return E.motif_counts(cop_edges(spark, sf), 3)


#: Shares of derivations that the sampled enumeration keeps at its three levels.
SHARES = (0.02, 0.02, 0.05)


def _esu_sql(edges: str, shares: tuple[float, ...]) -> str:
    """The sampled enumeration of sets of len(shares) + 1 vertices."""

    def drawn(nodes: str, nbr: str, share: float) -> str:
        return f"('0x' || substr(md5('42:' || array_to_string({nodes}, ',') || ':' || {nbr}), 1, 8))::BIGINT < {int(share * 2**32)}"

    out = [f"WITH {edges}, {SQL_ADJ}, s2 AS (SELECT [id, nbr] AS nodes, [0, 1] AS masks FROM adj WHERE id < nbr AND {drawn('[id]', 'nbr', shares[0])})"]
    for k, share in enumerate(shares[1:], 3):
        out.append(f"c{k} AS (SELECT nodes, masks, nbr, bit_or(1 << (i - 1)::INT) AS mask FROM (SELECT nodes, masks, unnest(range(1, {k})) AS i FROM s{k - 1}) JOIN adj ON adj.id = nodes[i] WHERE nbr > nodes[1] AND NOT list_contains(nodes, nbr) AND {drawn('nodes', 'nbr', share)} GROUP BY ALL)")
        out.append(f"s{k} AS (SELECT list_append(nodes, nbr) AS nodes, list_append(masks, mask) AS masks FROM c{k} WHERE (mask & -mask, nbr) > (masks[-1] & -masks[-1], nodes[-1]))")
    return ",\n".join(out)


_DEGREES = "array_to_string(list_sort(list_transform(range(1, 5), lambda i: bit_count(masks[i]::INT) + len(list_filter(masks[i + 1:], lambda m: (m >> (i - 1)::INT) & 1 = 1)))), ',')"


@query("esu_size4", f"{_esu_sql(SQL_COP, SHARES)} SELECT {_DEGREES} AS degrees, list_sum(list_transform(masks, lambda m: bit_count(m::INT)))::BIGINT AS m, count(*) AS n, count(*) / {SHARES[0] * SHARES[1] * SHARES[2]!r}::DOUBLE AS estimate FROM s4 GROUP BY ALL")
def esu_size4(spark, sf):
    """The sampled enumeration: every set of four has the same chance, whatever its shape. All sets of four of a graph with hubs are more than any cluster lists."""
    return E.motif_counts(cop_edges(spark, sf), 4, SHARES)


_TREE = "t AS (SELECT n_nationkey AS a, 1000000 + n_regionkey AS b FROM nation UNION ALL SELECT 2000000 + s_suppkey, s_nationkey FROM supplier), d AS (SELECT id, count(*) AS k FROM (SELECT a AS id FROM t UNION ALL SELECT b FROM t) GROUP BY id)"


@query("esu_size4_tree", f"WITH {_TREE} SELECT '1,1,1,3' AS degrees, 3::BIGINT AS m, (SELECT sum(k * (k - 1) * (k - 2) / 6) FROM d)::BIGINT AS n UNION ALL SELECT '1,1,2,2', 3, (SELECT sum((x.k - 1) * (y.k - 1)) FROM t JOIN d x ON x.id = a JOIN d y ON y.id = b)::BIGINT")
def esu_size4_tree(spark, sf):
    """All sets of four of the tree of regions, nations and suppliers."""
    e = star_edges(spark, sf).where(F.col("type").isin("in_region", "in_nation"))
    return E.motif_counts(e.where(F.col("src") < 3 * TAG).unionAll(e.where(F.col("src") >= 4 * TAG)), 4)


@query("orbit_counts", f"WITH {SQL_COP}, {SQL_ADJ}, {_TRI}, t AS (SELECT id, count(*) AS t FROM (SELECT a AS id FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) GROUP BY id), d AS (SELECT id, count(*) AS k FROM adj GROUP BY id), w AS (SELECT adj.id, sum(d.k - 1) AS walks FROM adj JOIN d ON d.id = adj.nbr GROUP BY adj.id) SELECT d.id, k AS edge, CAST(walks - 2 * coalesce(t, 0) AS BIGINT) AS wedge_end, CAST(k * (k - 1) / 2 - coalesce(t, 0) AS BIGINT) AS wedge_mid, coalesce(t, 0) AS triangle FROM d JOIN w USING (id) LEFT JOIN t USING (id)")
def orbit_counts(spark, sf):
    return X.orbits3(cop_edges(spark, sf))


@query("orbit_dominance", f"WITH {SQL_COP}, {SQL_ADJ}, d AS (SELECT id, count(*) AS k FROM adj GROUP BY id), w AS (SELECT adj.id, sum(d.k - 1) AS walks FROM adj JOIN d ON d.id = adj.nbr GROUP BY adj.id), v AS (SELECT d.id, k, walks FROM d JOIN w USING (id)) SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id AND NOT (a.k < b.k OR a.walks < b.walks)")
def orbit_dominance(spark, sf):
    v = T.degrees_and_walks(T.neighbour_lists(cop_edges(spark, sf, repeats=True))).select("id", F.array(F.col("degree").cast("double"), F.col("walks").cast("double")).alias("v"))
    return dominance(v, v).where("pattern <> target").select(F.col("target").alias("a"), F.col("pattern").alias("b"))


@query("dataset_summary", f"WITH {SQL_COP}, n AS (SELECT count(*) AS n FROM part), m AS (SELECT count(*) AS m FROM cop) SELECT n, m, round(2.0::DOUBLE * m / (n * (n - 1)), 9) AS density, CASE WHEN 2.0::DOUBLE * m / (n * (n - 1)) > 0.5 THEN 'very-dense' WHEN 2.0::DOUBLE * m / (n * (n - 1)) > 0.3 THEN 'dense' ELSE 'sparse' END AS file_class, CASE WHEN 2.0::DOUBLE * m / (n * (n - 1)) < 0.1 THEN 'sparse' WHEN 2.0::DOUBLE * m / (n * (n - 1)) < 0.5 THEN 'medium' ELSE 'dense' END AS page_class FROM n, m")
def dataset_summary(spark, sf):
    n = cop_vertices(spark, sf).agg(F.count("*").alias("n")).crossJoin(cop_edges(spark, sf).agg(F.count("*").alias("m")))
    d = S.density(F.col("n"), F.col("m"), False)
    return n.select("n", "m", F.round(d, 9).alias("density"), S.density_name(d).alias("file_class"), S.density_class(d).alias("page_class"))


@query("mean_path_length", f"WITH RECURSIVE {SQL_SE}, {SQL_SADJ}, a AS MATERIALIZED (SELECT id, nbr FROM sadj), h(seed, id, depth) AS (SELECT DISTINCT id, id, 0 FROM a WHERE id < {2 * TAG} UNION SELECT h.seed, a.nbr, h.depth + 1 FROM h JOIN a ON a.id = h.id WHERE h.depth < 2), d AS (SELECT seed, id, min(depth) AS depth FROM h GROUP BY seed, id) SELECT seed AS id, round(avg(depth), 6) AS mean_path FROM d WHERE depth > 0 GROUP BY seed")
def mean_path_length(spark, sf):
    e = star_edges(spark, sf)
    seeds = star_vertices(spark, sf).where("label = 'region'").select("id")
    return X.mean_path_length(e, seeds, 2).select("id", F.round("mean_path", 6).alias("mean_path"))


@query("reach_summary")
def reach_summary(spark, sf):
    """Diameter and mean distance of the co-purchase graph over all of its vertices, by sketches."""
    return X.distance_summary(X.reach(cop_vertices(spark, sf), cop_edges(spark, sf), lg_k=10))


def _forest(spark, sf):
    """Regions, nations and suppliers."""
    e = star_edges(spark, sf).where(F.col("type").isin("in_region", "in_nation"))
    return e.where((F.col("src") < 3 * TAG) | (F.col("src") >= 4 * TAG))


#: Of trees of three levels: which shares of paths from flagged vertices each one parts.
_BETWEEN = f"""WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, (s_suppkey % 20 = 0)::INT AS f FROM supplier),
n AS (SELECT n_nationkey AS n, n_regionkey AS r, (n_nationkey % 20 = 0)::INT AS fn, count(s.k) AS k, coalesce(sum(s.f), 0) AS f FROM nation LEFT JOIN s ON s.n = n_nationkey GROUP BY ALL),
t AS (SELECT r, 1 + count(*) + sum(k) AS t, (r % 20 = 0)::INT + sum(f + fn) AS ft FROM n GROUP BY r), z AS (SELECT sum(t) AS all_n, sum(ft) AS all_k FROM t),
b AS (SELECT {4 * TAG} + k AS id, 0 AS x FROM s UNION ALL SELECT {2 * TAG} + n, f * (t - 2) + (ft - f - fn) * k FROM n JOIN t USING (r) UNION ALL SELECT {TAG} + r, sum((f + fn) * (t - 2 - k)) FROM n JOIN t USING (r) GROUP BY r)
SELECT id::BIGINT AS id, round(x::DOUBLE * all_n / all_k / ((all_n - 1) * (all_n - 2)), 9) AS betweenness FROM b, z"""


@query("betweenness_sampled", _BETWEEN)
def betweenness_sampled(spark, sf):
    """Paths from the vertices with an id divisible by 20 in the trees of regions, nations and suppliers."""
    e = _forest(spark, sf)
    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return X.betweenness(e, ids.where("id % 20 = 0"), ()).select("id", F.round("betweenness", 9).alias("betweenness"))


#: A bipartite graph has no triangle, so that counts of paths, stars and squares follow from degrees and shared neighbours.
_ORBITS4 = f"""WITH e AS (SELECT DISTINCT {6 * TAG} + l_orderkey AS a, {5 * TAG} + l_partkey AS b FROM lineitem), adj AS (SELECT a AS id, b AS nbr FROM e UNION ALL SELECT b, a FROM e),
d AS (SELECT id, count(*) AS k FROM adj GROUP BY id), near AS (SELECT adj.id, sum(d.k - 1) AS ends, sum((d.k - 1) * (d.k - 2) / 2) AS leaf FROM adj JOIN d ON d.id = nbr GROUP BY adj.id),
two AS (SELECT x.id, y.nbr AS w, count(*) AS c FROM adj x JOIN adj y ON y.id = x.nbr AND y.nbr <> x.id GROUP BY ALL),
far AS (SELECT two.id, sum(c * (d.k - 1)) AS paths, sum(c * (c - 1) / 2) AS squares FROM two JOIN d ON d.id = w GROUP BY two.id)
SELECT d.id, k AS o0, (k * (k - 1) / 2)::BIGINT AS o1, ends::BIGINT AS o2, (k * (k - 1) * (k - 2) / 6)::BIGINT AS o4, leaf::BIGINT AS o5, ((k - 1) * ends - 2 * coalesce(squares, 0))::BIGINT AS o6, (coalesce(paths, 0) - 2 * coalesce(squares, 0))::BIGINT AS o7, coalesce(squares, 0)::BIGINT AS o11, {', '.join(f'0::BIGINT AS o{i}' for i in (3, 8, 9, 10, 12, 13, 14))}
FROM d JOIN near USING (id) LEFT JOIN far USING (id)"""


@query("orbit_counts4", _ORBITS4)
def orbit_counts4(spark, sf):
    """How often orders and parts hold each of the fifteen places of up to four vertices."""
    e = star_edges(spark, sf).where("type = 'contains'")
    v = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return X.orbit_counts(v, e, 4).select("id", *(F.col("orbits")[i].alias(f"o{i}") for i in range(15)))


@query("mean_clustering", f"WITH {SQL_COP}, {SQL_ADJ}, {_TRI}, t AS (SELECT id, count(*) AS t FROM (SELECT a AS id FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) GROUP BY id), d AS (SELECT id, count(*) AS k FROM adj GROUP BY id) SELECT round(sum(CASE WHEN k > 1 THEN 2.0::DOUBLE * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END) / (SELECT count(*) FROM part), 6) AS mean_clustering, round(3.0::DOUBLE * (SELECT count(*) FROM tri) / sum(k * (k - 1) / 2), 6) AS transitivity FROM d LEFT JOIN t USING (id)")
def mean_clustering(spark, sf):
    return X.mean_clustering(cop_vertices(spark, sf), cop_edges(spark, sf)).select(*(F.round(c, 6).alias(c) for c in ("mean_clustering", "transitivity")))
