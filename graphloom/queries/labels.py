"""Labels, vocabularies, hashes, scalar features, reports and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import normalise
from graphloom.functions import scalar as S
from graphloom.operators import features as X
from graphloom.operators import report as R
from graphloom.operators import vocab as V
from graphloom.plans.views import SQL_COP, SQL_SE, SQL_SV, cop_edges, star_edges, star_vertices, table
from graphloom.queries.registry import query
from graphloom.sinks import writers as W
from graphloom.streaming import motifs as M

_STABLE = "('0x' || substr(md5({}), 1, 15))::BIGINT % 2147483647"


@query("edge_attr_sanitize", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, value AS w, 2::BIGINT AS n_attrs FROM events")
def edge_attr_sanitize(spark, sf):
    e = table(spark, sf, "events")
    attrs = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("type"), "event_type", F.lit(" "), F.lit("1"), F.lit("weight"), F.col("value").cast("string")))
    kept = S.numeric_attrs(attrs)
    return e.select("event_id", kept["k"].alias("k"), S.weight(kept["weight"].cast("string")).alias("w"), F.size(kept).cast("long").alias("n_attrs"))


@query("label_resolution", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS label, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'rel' END AS type, 'event' AS view_type FROM events")
def label_resolution(spark, sf):
    e = table(spark, sf, "events")
    node = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("semantic_label"), F.lit(None).cast("string"), F.lit("label"), F.col("event_type"))).otherwise(F.create_map(F.lit("label"), F.col("event_type")))
    edge = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("type_str"), F.col("event_type"), F.lit("relation"), F.lit("rel"))).otherwise(F.create_map(F.lit("relation"), F.lit("rel"), F.lit("label"), F.lit("x")))
    view = F.create_map(F.lit("kind"), F.lit("event"), F.lit("class"), F.lit("other"))
    return e.select("event_id", S.node_label(node).alias("label"), S.first_of(edge, S.EDGE_TYPE_KEYS).alias("type"), S.first_of(view, S.VIEW_NODE_KEYS).alias("view_type"))


_ODD = "CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN ' unk ' WHEN 3 THEN 'None' WHEN 4 THEN '12.5' ELSE ' ' || event_type END"


def _odd(e):
    n = F.col("event_id") % 7
    return e.withColumn("t", F.when(n == 1, "  ").when(n == 2, " unk ").when(n == 3, "None").when(n == 4, "12.5").when(n != 0, F.concat(F.lit(" "), "event_type")))


@query("safe_label_text", f"SELECT event_id, CASE WHEN t IS NULL OR trim(t) = '' THEN 'STRUCTURAL' WHEN lower(trim(t)) IN ('unk', 'unknown', 'none', 'null', 'nan') THEN 'UNKNOWN' ELSE trim(t) END AS label, CASE WHEN trim(t) <> '' AND try_cast(t AS DOUBLE) IS NULL THEN trim(t) END AS text FROM (SELECT event_id, {_ODD} AS t FROM events)")
def safe_label_text(spark, sf):
    return _odd(table(spark, sf, "events")).select("event_id", S.safe_label(F.col("t")).alias("label"), S.non_numeric(F.col("t")).alias("text"))


@query("label_vocab", "SELECT p_brand AS value, row_number() OVER (ORDER BY p_brand) AS id FROM (SELECT DISTINCT p_brand FROM part)")
def label_vocab(spark, sf):
    return V.build(table(spark, sf, "part"), "p_brand")


@query("vocab_encode", "WITH v AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS id FROM (SELECT DISTINCT p_brand FROM part)) SELECT p.p_partkey, coalesce(v.id, 0) AS label_id FROM part p LEFT JOIN v USING (p_brand)")
def vocab_encode(spark, sf):
    p = table(spark, sf, "part")
    return V.encode(p, "p_brand", V.build(p, "p_brand"), "label_id").select("p_partkey", "label_id")


@query("label_sources_union", "SELECT DISTINCT label FROM (SELECT p_brand AS label FROM part UNION SELECT c_mktsegment FROM customer UNION SELECT event_type FROM events UNION SELECT unnest(['Gene', 'TF']))")
def label_sources_union(spark, sf):
    from graphloom.sources.readers import label_arguments

    own = [table(spark, sf, t).select(F.col(c).alias("label")) for t, c in (("part", "p_brand"), ("customer", "c_mktsegment"), ("events", "event_type"))]
    return own[0].unionByName(own[1]).unionByName(own[2]).unionByName(label_arguments(spark, "Gene, TF,,")).distinct()


@query("stable_ids", f"SELECT DISTINCT p_brand AS label, {_STABLE.format('p_brand')} AS stable, {_STABLE.format('p_brand')} + 1 AS label_id, md5(p_brand) AS cache_key FROM part")
def stable_ids(spark, sf):
    b = F.col("label")
    return table(spark, sf, "part").select(F.col("p_brand").alias("label")).distinct().select("label", S.stable_int(b).alias("stable"), S.hashed_label_id(b).alias("label_id"), S.cache_key(b).alias("cache_key"))


@query("text_signature", f"WITH x AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(0, 64) r(i)), s AS (SELECT vec_id, string_agg(CAST(i * 2 + CASE WHEN v >= 0 THEN 1 ELSE 0 END AS VARCHAR), ',' ORDER BY abs(v) DESC, i) AS sig FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, i) AS r FROM x) WHERE r <= 8 GROUP BY vec_id) SELECT vec_id, sig, {_STABLE.format(chr(39) + 'textsig::' + chr(39) + ' || sig')} AS bucket FROM s")
def text_signature(spark, sf):
    sig = S.text_signature(F.col("embedding"), 8)
    return table(spark, sf, "embeddings").select("vec_id", sig.alias("s")).select("vec_id", F.array_join(F.col("s").cast("array<string>"), ",").alias("sig"), S.text_bucket(F.col("s")).alias("bucket"))


@query("node_edge_mix_bits", "SELECT p_partkey, xor(p_partkey << 1, (p_size::BIGINT << 3) | (p_size::BIGINT >> 2)) AS node, xor(p_size::BIGINT * 1315423911, 11) AS fwd, xor(p_size::BIGINT * 1315423911, 19) AS bwd FROM part")
def node_edge_mix_bits(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.node_mix(F.col("p_partkey"), F.col("p_size")).alias("node"), S.edge_mix(F.col("p_size"), True).alias("fwd"), S.edge_mix(F.col("p_size"), False).alias("bwd"))


@query("pair_hash_type", "SELECT a, b, h, h % 4 + 1 AS type_id, ['regulates', 'transcribes', 'translates', 'catalyzes'][h % 4 + 1] AS type FROM (SELECT a, b, CAST(list_sum([i * ascii(substr(s, i, 1)) for i in range(1, len(s) + 1)]) AS BIGINT) AS h FROM (SELECT DISTINCT x.c_mktsegment AS a, y.p_type AS b, x.c_mktsegment || '->' || y.p_type AS s FROM (SELECT DISTINCT c_mktsegment FROM customer) x, (SELECT DISTINCT p_type FROM part) y))")
def pair_hash_type(spark, sf):
    from graphloom.models.training import PRESETS

    a = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("a")).distinct()
    b = table(spark, sf, "part").select(F.col("p_type").alias("b")).distinct()
    types = F.array(*map(F.lit, PRESETS["biology"]["types"]))
    p = a.crossJoin(b).withColumn("h", S.pair_hash(F.col("a"), F.col("b")))
    return p.select("a", "b", "h", (F.col("h") % 4 + 1).alias("type_id"), F.element_at(types, (F.col("h") % 4 + 1).cast("int")).alias("type"))


@query("one_hot_features", "SELECT p_partkey, array_to_string(list_transform(range(0, 16), lambda i: CASE WHEN i = b THEN 1 ELSE 0 END), '') AS bits, least(greatest(p_size, 0), 31) AS relation FROM (SELECT *, CASE WHEN p_size % 5 = 0 THEN 0 ELSE 1 + p_size % 15 END AS b FROM part)")
def one_hot_features(spark, sf):
    p = table(spark, sf, "part").withColumn("label_id", F.when(F.col("p_size") % 5 == 0, 0).otherwise(F.col("p_size")))
    return X.label_one_hot(p.withColumnRenamed("p_partkey", "id")).select(F.col("id").alias("p_partkey"), F.array_join(F.col("label_one_hot").cast("array<string>"), "").alias("bits")).join(p.select("p_partkey", S.clamp_relation(F.col("p_size"), 32).alias("relation")), "p_partkey")


@query("bin_features", "SELECT p_partkey, CAST(least(greatest(floor((p_retailprice - 900) / 20), 0), 9) AS INTEGER) AS bin FROM part")
def bin_features(spark, sf):
    return X.edge_features(table(spark, sf, "part"), "p_retailprice", 900, 1100, 10).select("p_partkey", "bin")


@query("wave_features", "SELECT p_partkey, list_transform(range(0, 4), lambda i: round(CASE WHEN i % 2 = 0 THEN sin(p_size / pow(10000.0, i / 4.0)) ELSE cos(p_size / pow(10000.0, (i - 1) / 4.0)) END, 6)) AS wave FROM part")
def wave_features(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.transform(S.wave(F.col("p_size"), 4), lambda x: F.round(x, 6)).alias("wave"))


@query("l2_normalized", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings")
def l2_normalized(spark, sf):
    v = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.round(S.l2_norm(v), 6).alias("norm"), F.round(S.l2_normalize(v)[0], 6).alias("first"))


@query("split_80_20", "SELECT n_nationkey, CASE WHEN ntile(5) OVER (ORDER BY md5('42:' || n_nationkey), n_nationkey) <= 4 THEN 'train' ELSE 'test' END AS part FROM nation")
def split_80_20(spark, sf):
    from pyspark.sql import Window

    w = Window.orderBy(F.md5(F.concat_ws(":", F.lit(42), "n_nationkey")), "n_nationkey")
    return table(spark, sf, "nation").select("n_nationkey", F.when(F.ntile(5).over(w) <= 4, "train").otherwise("test").alias("part"))


@query("norm_by_size_heatmap", "SELECT label, vec_id % 4 AS m, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS norm FROM embeddings GROUP BY label, vec_id % 4")
def norm_by_size_heatmap(spark, sf):
    return table(spark, sf, "embeddings").groupBy("label", (F.col("vec_id") % 4).alias("m")).agg(F.round(F.avg(S.l2_norm(F.col("embedding"))), 6).alias("norm"))


# Instances stand for discovered patterns: size from the number of parts of an order, hash from its status and priority.
_INST = "inst AS (SELECT o_orderkey AS id, CAST(o_orderkey % 3 + 3 AS INTEGER) AS size, md5(o_orderpriority || o_orderstatus) AS hash, round(o_totalprice, 2) AS score FROM orders)"


def _instances(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3 + 3).cast("int").alias("size"), F.md5(F.concat("o_orderpriority", "o_orderstatus")).alias("hash"), F.round("o_totalprice", 2).alias("score"))


@query("size_rank_topk", f"WITH {_INST}, c AS (SELECT size, hash, count(*) AS n FROM inst GROUP BY size, hash), r AS (SELECT *, row_number() OVER (PARTITION BY size ORDER BY n DESC, hash) AS rank FROM c) SELECT size, rank::INTEGER AS rank, 'size_' || size || '_rank_' || rank AS key, hash, n FROM r WHERE rank <= 3")
def size_rank_topk(spark, sf):
    return R.rank_patterns(_instances(spark, sf).groupBy("size", "hash").agg(F.count("*").alias("n")), 3)


@query("margin_unique_topk", f"WITH {_INST}, b AS (SELECT *, row_number() OVER (PARTITION BY size, hash ORDER BY score, id) AS k FROM inst), r AS (SELECT *, row_number() OVER (PARTITION BY size ORDER BY score, hash) AS rank FROM b WHERE k = 1) SELECT id, size, hash, score, rank::INTEGER AS rank FROM r WHERE rank <= 3")
def margin_unique_topk(spark, sf):
    return R.best_margin_unique(_instances(spark, sf), 3)


@query("hybrid_rank", f"WITH {_INST}, n AS (SELECT size, hash, count(*) AS n, min(score) AS score FROM inst GROUP BY size, hash), m AS (SELECT size, max(n) AS most FROM n GROUP BY size), r AS (SELECT size, hash, row_number() OVER (PARTITION BY size ORDER BY CASE WHEN most < 3 THEN score ELSE -n END, hash) AS rank FROM n JOIN m USING (size)) SELECT size, hash, rank::INTEGER AS rank FROM r WHERE rank <= 3")
def hybrid_rank(spark, sf):
    return R.hybrid_rank(_instances(spark, sf), 3)


@query("unique_hashes", f"WITH {_INST} SELECT size, count(DISTINCT hash) AS n FROM inst GROUP BY size")
def unique_hashes(spark, sf):
    return _instances(spark, sf).groupBy("size").agg(F.countDistinct("hash").alias("n"))


@query("motif_rollup_report", f"WITH {_INST} SELECT size, hash, count(*) AS n FROM inst GROUP BY ROLLUP (size, hash)")
def motif_rollup_report(spark, sf):
    return R.motif_rollup(_instances(spark, sf))


@query("instance_dedupe_rates", "WITH i AS (SELECT l_returnflag AS pattern, list_sort([l_partkey % 50, l_suppkey % 50]) AS nodes FROM lineitem), g AS (SELECT pattern, nodes, count(*) AS k FROM i GROUP BY pattern, nodes), t AS (SELECT pattern, CAST(sum(k) AS BIGINT) AS o, count(*) AS u FROM g GROUP BY pattern) SELECT pattern, o AS original_count, u AS unique_count, o - u AS duplicates_removed, round((o - u)::DOUBLE / o, 6) AS duplication_rate, round(o::DOUBLE / 1000, 6) AS frequency_score, round(o::DOUBLE / u, 6) AS discovery_rate FROM t")
def instance_dedupe_rates(spark, sf):
    i = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("pattern"), F.array(F.col("l_partkey") % 50, F.col("l_suppkey") % 50).alias("nodes"))
    r = R.instance_rates(i, 1000)
    return r.withColumns({c: F.round(c, 6) for c in ("duplication_rate", "frequency_score", "discovery_rate")})


@query("representative_pattern", "WITH i AS (SELECT l_orderkey AS id, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) AS q, count(*) FILTER (WHERE l_returnflag = 'R') AS a, count(DISTINCT l_linestatus) AS d FROM lineitem GROUP BY l_orderkey), s AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END AS pattern, round(-list_var_pop(q) + 10 * a + 5 * d, 6) AS score FROM i) SELECT pattern, id, score FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY score DESC, id) AS r FROM s) WHERE r = 1")
def representative_pattern(spark, sf):
    i = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_quantity").alias("degrees"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("n_anchors"), F.collect_set("l_linestatus").alias("labels"))
    return R.representative(i.withColumn("pattern", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))).withColumn("score", F.round("score", 6))


@query("count_summary_iqr", "SELECT o_orderpriority AS pattern, round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q75 FROM orders GROUP BY o_orderpriority")
def count_summary_iqr(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("pattern"), "o_totalprice")
    return R.quartiles(o, "pattern", "o_totalprice").select("pattern", *(F.round(c, 4).alias(c) for c in ("q25", "median", "q75")))


@query("count_spread", "SELECT low, high, round(high / low, 6) AS ratio, round(log10(high / low), 6) AS orders, CASE WHEN high / low > 100 THEN 'ESSENTIAL' ELSE 'RECOMMENDED' END AS log_scale FROM (SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders)")
def count_spread(spark, sf):
    return R.spread(table(spark, sf, "orders"), "o_totalprice").withColumns({"ratio": F.round("ratio", 6), "orders": F.round("orders", 6)})


@query("short_numbers", "SELECT o_orderkey, CASE WHEN x >= 1e9 THEN printf('%.0fB', x / 1e9) WHEN x >= 1e6 THEN printf('%.0fM', x / 1e6) WHEN x >= 1e3 THEN printf('%.0fK', x / 1e3) WHEN x >= 1 THEN CAST(floor(x)::BIGINT AS VARCHAR) ELSE printf('%.1f', x) END AS short FROM (SELECT o_orderkey, (o_orderkey % 10 + 0.25) * pow(10.0, (o_orderkey % 11 - 1)::DOUBLE) AS x FROM orders)")
def short_numbers(spark, sf):
    x = (F.col("o_orderkey") % 10 + F.lit(0.25)) * F.pow(F.lit(10.0), (F.col("o_orderkey") % 11 - 1).cast("double"))
    return table(spark, sf, "orders").select("o_orderkey", S.short_number(x).alias("short"))


@query("file_names", "SELECT p_partkey, substr(regexp_replace(regexp_replace('dir_' || p_name || '_' || p_brand || '/?_:' || p_type, '[<>:\"/\\\\|?*]', '_', 'g'), '_+', '_', 'g'), 1, 100) AS file, array_to_string(['brand: ' || p_brand, 'size: ' || p_size], ', ') AS display FROM part")
def file_names(spark, sf):
    name = F.concat(F.lit("dir_"), "p_name", F.lit("_"), "p_brand", F.lit("/?_:"), "p_type")
    attrs = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"), F.lit("id"), F.lit("x"))
    return table(spark, sf, "part").select("p_partkey", S.clean_filename(name).alias("file"), S.display_label(attrs, ("id", "label")).alias("display"))


@query("type_legend", "SELECT event_type AS type, (dense_rank() OVER (ORDER BY event_type) - 1) % 3 AS colour, upper(substr(event_type, 1, 1)) || substr(event_type, 2) || ' Edge' AS title FROM (SELECT DISTINCT event_type FROM events)")
def type_legend(spark, sf):
    from pyspark.sql import Window

    t = table(spark, sf, "events").select(F.col("event_type").alias("type")).distinct()
    return t.select("type", ((F.dense_rank().over(Window.orderBy("type")) - 1) % 3).cast("long").alias("colour"), S.type_title(F.concat("type", F.lit("_edge"))).alias("title"))


@query("resume_antijoin", "SELECT o_orderkey AS task_id FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 10 <> 3")
def resume_antijoin(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), "o_orderstatus")
    return R.open_tasks(o, o.where("o_orderstatus = 'F'"), o.where("task_id % 10 = 3")).select("task_id")


_REGION = f"FROM nation WHERE n_regionkey = r_regionkey"  # noqa: F541


@query("pattern_json", f"""SELECT r_regionkey AS pattern, '{{"nodes":[' || (SELECT string_agg('{{"id":' || n_nationkey || ',"label":"nation","anchor":0}}', ',' ORDER BY n_nationkey) {_REGION}) || ',{{"id":' || (100 + r_regionkey) || ',"label":"region","anchor":1}}],"edges":[' || (SELECT string_agg('{{"source":' || n_nationkey || ',"target":' || (100 + r_regionkey) || ',"type":"in_region"}}', ',' ORDER BY n_nationkey) {_REGION}) || '],"metadata":{{"num_nodes":' || (SELECT count(*) + 1 {_REGION}) || ',"num_edges":' || (SELECT count(*) {_REGION}) || ',"is_directed":true}}}}' AS json FROM region""")
def pattern_json(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    nodes = n.select(F.col("n_regionkey").alias("pattern"), F.col("n_nationkey").cast("long").alias("id"), F.lit("nation").alias("label"), F.lit(0).alias("anchor"))
    nodes = nodes.unionByName(r.select(F.col("r_regionkey").alias("pattern"), (F.col("r_regionkey") + 100).cast("long").alias("id"), F.lit("region").alias("label"), F.lit(1).alias("anchor")))
    edges = n.select(F.col("n_regionkey").alias("pattern"), F.col("n_nationkey").cast("long").alias("src"), (F.col("n_regionkey") + 100).cast("long").alias("dst"), F.lit("in_region").alias("type"))
    return W.pattern_json(nodes, edges)


@query("viz_payload", "SELECT n_regionkey AS pattern, count(*) AS node_count, round(CASE WHEN count(*) > 1 THEN 0.0::DOUBLE / (count(*) * (count(*) - 1)) ELSE 0.0 END, 6) AS density, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS types FROM nation GROUP BY n_regionkey")
def viz_payload(spark, sf):
    n = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("pattern")).agg(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"))).alias("nodes"))
    n = n.withColumn("edges", F.array().cast("array<struct<source:bigint,target:bigint,type:string>>"))
    meta, legend = W.payload(F.concat(F.lit("Pattern "), F.col("pattern").cast("string")), True)
    p = n.select("pattern", meta.alias("m"), legend.alias("l"))
    return p.select("pattern", F.col("m.nodeCount").cast("long").alias("node_count"), F.col("m.density").alias("density"), F.array_join("l.nodeTypes", ",").alias("types"))


@query("degree_variance_by_label", f"WITH {SQL_SV}, {SQL_SE}, d AS (SELECT src AS id, count(*) AS k FROM se GROUP BY src) SELECT label, round(var_pop(coalesce(k, 0)), 4) AS variance FROM sv LEFT JOIN d USING (id) GROUP BY label")
def degree_variance_by_label(spark, sf):
    d = star_edges(spark, sf).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k"))
    return star_vertices(spark, sf).join(d, "id", "left").groupBy("label").agg(F.round(F.var_pop(F.coalesce("k", F.lit(0))), 4).alias("variance"))


@query("db_import", "WITH v AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Special' WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE 'Node' END AS label, row_number() OVER (ORDER BY 'c' || c_custkey) - 1 AS id FROM customer), e AS (SELECT o_custkey AS a, (o_orderkey % 100) AS b FROM orders) SELECT least(x.id, y.id) AS src, greatest(x.id, y.id) AS dst, min(CASE WHEN x.label = '' THEN '' ELSE 'knows' END) AS type FROM e JOIN v x ON x.c_custkey = a JOIN v y ON y.c_custkey = b GROUP BY 1, 2")
def db_import(spark, sf):
    from graphloom.sources.readers import from_tables

    n = F.col("c_custkey")
    nodes = table(spark, sf, "customer").select(F.concat(F.lit("c"), n.cast("string")).alias("ext_id"), F.when(n % 3 == 1, F.array("c_mktsegment")).otherwise(F.array().cast("array<string>")).alias("labels"), F.when(n % 3 == 0, "Special").alias("custom_label"))
    ext = lambda c: F.concat(F.lit("c"), c.cast("string"))
    rel = table(spark, sf, "orders").select(ext(F.col("o_custkey")).alias("from_id"), ext(F.col("o_orderkey") % 100).alias("to_id"), F.lit("knows").alias("type"))
    both = rel.unionByName(rel.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "type"))
    return from_tables(nodes, both).edges


@query("stream_motif_windows", "SELECT date_trunc('day', ts) AS start, event_type AS dst, count(*) AS n FROM events GROUP BY 1, 2")
def stream_motif_windows(spark, sf):
    return M.tumbling(M.edge_stream(table(spark, sf, "events"))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id AS src, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def stream_sessions(spark, sf):
    return M.sessions(M.edge_stream(table(spark, sf, "events"))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_steps", "WITH g AS (SELECT user_id, ts, event_type, lag(event_type) OVER w AS before, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_type ROWS UNBOUNDED PRECEDING) AS k FROM g), b AS (SELECT *, min(ts) OVER (PARTITION BY user_id, k) AS start FROM s) SELECT user_id AS src, start, before AS first, event_type AS second, count(*) AS n FROM b WHERE new = 0 GROUP BY ALL")
def stream_steps(spark, sf):
    """Which type of event follows which within a session; running_steps() keeps the same counts over a stream."""
    return M.steps(M.edge_stream(table(spark, sf, "events"))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("cop_brand_types", f"WITH {SQL_COP} SELECT a.p_brand AS a, b.p_brand AS b, count(*) AS n FROM cop JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst GROUP BY 1, 2")
def cop_brand_types(spark, sf):
    p = table(spark, sf, "part")
    e = cop_edges(spark, sf).join(p.select(F.col("p_partkey").alias("src"), F.col("p_brand").alias("a")), "src").join(p.select(F.col("p_partkey").alias("dst"), F.col("p_brand").alias("b")), "dst")
    return e.groupBy("a", "b").agg(F.count("*").alias("n"))




def _drawn(u: str, weights) -> str:
    total, upto, out = sum(w for _, w in weights), 0.0, []
    for label, w in weights[:-1]:
        upto += w
        out.append(f"WHEN {u} < {upto / total!r} THEN '{label}'")
    return f"CASE {' '.join(out)} ELSE '{weights[-1][0]}' END"


def _uniform(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _labels_sql(preset: str) -> str:
    """(id, label) of annotated parts, a tenth of the labels left out."""
    from graphloom.models.training import PRESETS
    from graphloom.plans.views import SQL_ADJ, SQL_COP

    spec = PRESETS[preset]
    case = " ".join(f"WHEN bucket = '{b}' THEN {_drawn('u', spec[b])}" for b in ("high", "mid"))
    return f"WITH {SQL_COP}, {SQL_ADJ}, d AS (SELECT id, count(*) AS k FROM adj GROUP BY id), q AS (SELECT quantile_cont(k, 0.35) AS q1, quantile_cont(k, 0.75) AS q2 FROM d), b AS (SELECT p_partkey AS id, CASE WHEN k >= q2 THEN 'high' WHEN k <= q1 THEN 'low' WHEN k IS NOT NULL THEN 'mid' END AS bucket, {_uniform('42', 'p_partkey', '1')} AS u, {_uniform('42', 'p_partkey', '2')} AS w FROM part LEFT JOIN d ON id = p_partkey CROSS JOIN q), lab AS (SELECT id, CASE WHEN w >= 0.1 THEN CASE {case} ELSE {_drawn('u', spec['low'])} END END AS label FROM b)"


def _typed_sql(preset: str) -> str:
    from graphloom.models.training import PRESETS

    types = PRESETS[preset]["types"]
    named = "[" + ", ".join(f"'{t}'" for t in types) + "]"
    told = "a || '->' || b"
    return f"""{_labels_sql(preset)}, h AS (SELECT a, b, (CASE WHEN {told} IS NULL THEN 0 ELSE list_sum(list_transform(range(1, length({told}) + 1), lambda i: i * ascii(substr({told}, i::INT, 1)))) % {len(types)} + 1 END)::INT AS type_id
FROM (SELECT DISTINCT x.label AS a, y.label AS b FROM cop JOIN lab x ON x.id = src JOIN lab y ON y.id = dst)),
t AS (SELECT CASE WHEN type_id = 0 THEN 'unknown' WHEN {_uniform('42', 'src', 'dst', '3')} < 0.1 THEN {named}[floor({_uniform('42', 'src', 'dst', '4')} * {len(types)})::INT + 1] ELSE {named}[type_id] END AS type, type_id
FROM cop JOIN lab x ON x.id = src JOIN lab y ON y.id = dst JOIN h ON h.a IS NOT DISTINCT FROM x.label AND h.b IS NOT DISTINCT FROM y.label)
SELECT type, type_id, count(*) AS n FROM t GROUP BY ALL"""


@query("annotated_vertices", _labels_sql("universal") + " SELECT id, label FROM lab")
def annotated_vertices(spark, sf):
    from graphloom.models.annotate import annotate
    from graphloom.plans.views import cop_edges, cop_vertices

    return annotate(cop_vertices(spark, sf), cop_edges(spark, sf), "universal", 0.1)[0]


@query("annotated_edges", _typed_sql("biology"))
def annotated_edges(spark, sf):
    from graphloom.models.annotate import annotate
    from graphloom.plans.views import cop_edges, cop_vertices

    return annotate(cop_vertices(spark, sf), cop_edges(spark, sf), "biology", 0.1)[1].groupBy("type", "type_id").agg(F.count("*").alias("n"))


_LAW = [(s + 2) ** -1.1 for s in range(6)]


@query("size_law", "SELECT p_partkey, 3 + " + " + ".join(f"CASE WHEN {_uniform('42', 'p_partkey', '1')} >= {sum(_LAW[: i + 1]) / sum(_LAW)!r} THEN 1 ELSE 0 END" for i in range(5)) + " AS size FROM part")
def size_law(spark, sf):
    from graphloom.operators.sample import size_law as law
    from graphloom.operators.sample import uniform

    return table(spark, sf, "part").select("p_partkey", law(uniform(42, "p_partkey", 1), 3, 8).alias("size"))


_TYPE_ID = "(('0x' || substr(md5({t}), 1, 15))::BIGINT % 2147483647) % 1000000 + 1"


@query("normal_vertices", f"""SELECT c_custkey AS id, label, semantic_label, ('0x' || substr(md5(semantic_label), 1, 15))::BIGINT % 2147483647 + 1 AS label_id, CASE WHEN c_custkey = c_nationkey THEN 1.0 ELSE 0.0 END::DOUBLE AS node_feature
FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE c_custkey::VARCHAR END AS label, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN c_mktsegment ELSE 'STRUCTURAL' END AS semantic_label FROM customer)""")
def normal_vertices(spark, sf):
    """Customers with attributes of four kinds: a label, an unknown word, a meaning padded by blanks, none."""
    k, text = F.col("c_custkey"), lambda *kv: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in kv))
    attrs = F.when(k % 4 == 0, text("label", F.col("c_mktsegment"))).when(k % 4 == 1, text("semantic_label", "none")).when(k % 4 == 2, text("semantic_label", F.concat(F.lit("  "), "c_mktsegment")))
    v = table(spark, sf, "customer").select(k.cast("long").alias("id"), attrs.alias("attrs"), "c_nationkey")
    return normalise.normal_vertices(v, F.col("id") == F.col("c_nationkey")).drop("attrs")


@query("normal_edges", f"""SELECT l_orderkey AS src, l_partkey AS dst, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity::DOUBLE ELSE 1.0 END AS weight, type_name, (CASE WHEN l_linenumber = 3 THEN 7 ELSE {_TYPE_ID.format(t="type_name")} END)::BIGINT AS type_id, l_discount::DOUBLE AS discount, CASE WHEN l_linenumber = 3 THEN 5 ELSE 4 END - (l_linenumber = 3)::INT AS n_attrs
FROM (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN 'unknown' ELSE l_returnflag END AS type_name FROM lineitem)""")
def normal_edges(spark, sf):
    """Lines as edges with attributes of several kinds: numbers, a type or a number in its place, a text, a blank key."""
    n, entry = F.col("l_linenumber"), lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    attrs = F.array(
        entry("relation", F.when(n % 3 == 0, "12").otherwise(F.col("l_returnflag"))), entry("weight", F.when(n % 2 == 0, F.col("l_quantity").cast("double").cast("string")).otherwise("heavy")),
        entry("discount", F.col("l_discount").cast("double")), entry(" ", F.lit("1")), entry("note", F.lit("abc")), entry("type_id", F.when(n == 3, "7")),
    )
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.map_from_entries(F.filter(attrs, lambda x: x["value"].isNotNull())).alias("attrs"))
    return normalise.normal_edges(e).select("src", "dst", "weight", "type_name", "type_id", F.col("attrs")["discount"].alias("discount"), F.size(F.map_filter("attrs", lambda k, v: k != "relation")).alias("n_attrs"))
