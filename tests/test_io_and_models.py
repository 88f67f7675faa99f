import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.models import encoder as N
from graphloom.models import training as G
from graphloom.operators import search as S
from graphloom.sinks import writers as W
from graphloom.sources import readers as R
from graphloom.streaming import motifs


def test_edge_list(spark, tmp_path):
    p = tmp_path / "g.tsv"
    p.write_text("# head\n1\t2\n2\t1\n\n2\t3\n3\t3\n")
    g = R.edge_list(spark, str(p), r"\t")
    assert {(r.src, r.dst) for r in g.edges.collect()} == {(1, 2), (2, 3)}
    assert R.edge_list(spark, str(p), r"\t", directed=True).edges.count() == 4


def test_interchange(spark):
    g = R.interchange(spark, {"nodes": [(1, {"label": "a"}), 2], "edges": [(1, 2, {"relation": "r"}), (2, 1)]})
    assert {r.id: r.label for r in g.vertices.collect()} == {1: "a", 2: None}
    assert {(r.src, r.dst): r.type for r in g.edges.collect()} == {(1, 2): "r", (2, 1): None}


def test_tu_collection(spark, tmp_path):
    for name, text in {"A": "1, 2\n2, 1\n3, 4\n", "graph_indicator": "1\n1\n2\n2\n", "node_labels": "5\n6\n5\n5\n", "graph_labels": "0\n1\n"}.items():
        (tmp_path / f"T_{name}.txt").write_text(text)
    v, e, g = R.tu_collection(spark, str(tmp_path), "T")
    assert v.count() == 4 and {(r.graph_id, r.src, r.dst) for r in e.collect()} == {(1, 1, 2), (1, 2, 1), (2, 3, 4)} and g.count() == 2
    assert {r.id for r in R.first_graphs(v, 1).collect()} == {1, 2}
    (tmp_path / "COX2").mkdir()
    for name, text in {"A": "1, 2\n2, 1\n", "graph_indicator": "1\n1\n", "graph_labels": "0\n"}.items():
        (tmp_path / "COX2" / f"COX2_{name}.txt").write_text(text)
    v, e = R.collection(spark, "cox2", str(tmp_path))
    assert [tuple(r) for r in v.orderBy("id").collect()] == [(1, 1, None), (1, 2, None)] and e.count() == 2
    with pytest.raises(ValueError):
        R.collection(spark, "none")


def test_atlas(spark):
    v, e = R.atlas(spark, 6)
    n = Counter(r["count"] for r in v.groupBy("graph_id").count().collect())
    assert n == {1: 1, 2: 1, 3: 2, 4: 6, 5: 21, 6: 112}
    train, test = R.split_by_hash(v.select("graph_id").distinct(), "graph_id")
    assert train.count() + test.count() == 143 and e.where("src >= dst").count() == 0


def test_counts_and_labels(spark, tmp_path):
    (tmp_path / "a.json").write_text("[[3, 4], [10, 2], []]")
    assert {(r.name, r["size"], r.n) for r in R.count_files(spark, str(tmp_path)).collect()} == {("a", 3, 10.0), ("a", 4, 2.0)}
    (tmp_path / "l.txt").write_text("# x\nGene\n\n TF \n")
    assert {r.label for r in R.label_file(spark, str(tmp_path / "l.txt")).collect()} == {"Gene", "TF"}
    c = spark.createDataFrame([(0, 3, 10), (1, 4, 2)], "pattern int, size int, n long")
    assert json.loads(W.counts_json(c)) == [[3, 4], [10, 2], []]


def test_pages():
    data = {"metadata": {}, "nodes": [{"id": 1}], "edges": [{"source": 1, "target": 2}], "legend": {}}
    assert len(W.check_payload(data)) == 1
    out = W.page("<script>const GRAPH_DATA = {};</script>", {"a": "</script>"})
    assert "<\\/script>" in out and out.count("</script>") == 1
    with pytest.raises(ValueError):
        W.page("<p>", {})
    with pytest.raises(ValueError):
        R.resolve_metadata({"hidden": 1}, {"hidden": 2}, {"hidden"})


def test_encoder_is_invariant_to_order():
    spec = N.EncoderSpec(layers=2, hidden=8)
    x = np.eye(16)[[1, 2, 3]]
    src, dst, rel = np.array([0, 1, 1, 2]), np.array([1, 0, 2, 1]), np.zeros(4, int)
    a = N.forward(spec, x, src, dst, rel, np.zeros(3, int), 1)
    p = np.array([2, 0, 1])
    moved = np.empty_like(x)
    moved[p] = x
    b = N.forward(spec, moved, p[src], p[dst], rel, np.zeros(3, int), 1)
    assert np.allclose(a, b, atol=1e-5)


def test_text_vectors(spark):
    df = spark.createDataFrame([("Gene",), (None,), ("Gene",)], "label string")
    v = {r.label: r.vec for r in N.text_vectors(df).collect()}
    assert np.linalg.norm(v["Gene"]) == pytest.approx(1) and len(v) == 2
    with pytest.raises(Exception, match="no cached vector"):
        N.cached_vectors(df, N.text_vectors(df.where("label is not null"))).collect()


def test_synthetic_graphs_are_connected_and_repeatable(spark):
    rows = G.synthetic_graphs(spark, 12).collect()
    again = {r.graph_id: r.edges for r in G.synthetic_graphs(spark, 12).repartition(3).collect()}
    for r in rows:
        seen, grew = {0}, True
        while grew:
            more = {y for e in r.edges for x, y in ((e.src, e.dst), (e.dst, e.src)) if x in seen} - seen
            seen, grew = seen | more, bool(more)
        assert len(seen) == r.n and again[r.graph_id] == r.edges


def test_pairs(spark):
    rows = G.pair_batches(G.synthetic_graphs(spark, 40)).collect()
    for r in rows:
        assert G.contains(r.a_labels, [tuple(e) for e in r.a], r.b_labels, [tuple(e) for e in r.b]) == bool(r.label), r.kind
    assert {r.kind for r in rows} == {"positive", "label", "hard", "structure"}
    for r in rows:
        assert r.a_anchor in r.a_labels and r.b_anchor in r.b_labels
        if r.label:
            assert r.a_anchor == r.b_anchor and G.contains(r.a_labels, [tuple(e) for e in r.a], r.b_labels, [tuple(e) for e in r.b], (r.a_anchor, r.b_anchor))
        elif r.kind == "label":  # the same labels and edges, elsewhere
            assert set(r.b) <= set(r.a) and Counter(r.b_labels.values()) == Counter(r.a_labels[v] for v in r.b_labels)
        elif r.kind == "hard":
            assert len(set(r.b) - set(r.a)) == 1 and set(r.b_labels) <= set(r.a_labels)
    drawn = G.source("syn-imbalanced", spark, 60).collect()
    assert {r.label for r in drawn} == {0, 1}
    assert all(G.contains(r.a_labels, [tuple(e) for e in r.a], r.b_labels, [tuple(e) for e in r.b], (r.a_anchor, r.b_anchor)) == bool(r.label) for r in drawn)
    clique = spark.createDataFrame([(i, 5, [(a, b) for a in range(5) for b in range(a + 1, 5)], [2] * 5) for i in range(12)], "graph_id long, n int, edges array<struct<src:long,dst:long>>, labels array<int>")
    assert {r.label for r in G.pair_batches(clique).collect()} == {1}  # a part of a clique of one label is in every larger one
    assert G.batch_mix(16, 0.5, 0.25) == {"positive": 8, "label": 4, "hard": 1, "structure": 3}
    assert G.mix_weights(["1", "x"], ["a", "b"]) == [0.5, 0.5] and G.mix_weights(["1", "3"], ["a", "b"]) == [0.25, 0.75]


@pytest.mark.parametrize("agent", sorted(S.AGENTS))
def test_search_finds_the_common_pattern(spark, agent):
    tri = [(0, 1, ""), (1, 2, ""), (0, 2, "")]
    s = S.Store([(g, [(i, "a") for i in range(3)], tri) for g in range(5)])
    got = S.mine(spark, s, S.MineSpec(n_trials=8, min_size=3, max_size=3), agent).collect()
    assert len(got) == 1 and got[0]["size"] == 3 and got[0].n == 8


def test_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", i % 2, "click") for i in range(12)], "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = motifs.tumbling(motifs.edge_stream(stream, "10 days")).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, motifs.tumbling(motifs.edge_stream(events)).collect()))


def test_entry_point():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_pattern_json_passes_attributes_through(spark):
    nodes = spark.createDataFrame([(1, 5, "a", 1, {"score": 0.5, "label": 9.0}), (1, 3, 'q"x', 0, None), (2, 4, None, 0, {})], "pattern int, id long, label string, anchor int, attrs map<string,double>")
    edges = spark.createDataFrame([(1, 5, 3, "r", {"weight": 2.0}), (1, 3, 5, "r", {})], "pattern int, src long, dst long, type string, attrs map<string,double>")
    got = {r.pattern: json.loads(r.json) for r in W.pattern_json(nodes, edges).collect()}
    assert got[1]["nodes"] == [{"id": 3, "label": 'q"x', "anchor": 0}, {"id": 5, "label": "a", "anchor": 1, "score": 0.5}]
    assert got[1]["edges"] == [{"source": 3, "target": 5, "type": "r"}, {"source": 5, "target": 3, "type": "r", "weight": 2.0}]
    assert got[2] == {"nodes": [{"id": 4, "anchor": 0}], "edges": [], "metadata": {"num_nodes": 1, "num_edges": 0, "is_directed": True}}


@pytest.mark.parametrize("conv", N.CONVS)
def test_convolutions_do_not_depend_on_numbering(conv):
    rng = np.random.default_rng(3)
    src, dst = np.array([0, 1, 2, 3, 1, 0]), np.array([1, 2, 3, 1, 4, 4])
    both = np.concatenate([src, dst]), np.concatenate([dst, src])
    x, p, rel = rng.random((5, 16)).astype(np.float32), rng.permutation(5), np.tile(np.arange(6) % 3, 2)
    for agg in N.AGGS:
        spec = N.EncoderSpec(conv=conv, layers=2, hidden=6, agg=agg)
        a = N.forward(spec, x, *both, rel, np.zeros(5, int), 1)
        moved = np.empty_like(x)
        moved[p] = x
        assert np.isfinite(a).all() and np.allclose(a, N.forward(spec, moved, p[both[0]], p[both[1]], rel, np.zeros(5, int), 1), atol=1e-5)
    h = np.array([[1.0, -4.0], [3.0, 2.0], [5.0, 0.0]])
    s, d = np.array([1, 2]), np.array([0, 0])
    assert N.gather("mean", h, s, d, 3).tolist() == [[4, 1], [0, 0], [0, 0]] and N.gather("max", h, s, d, 3).tolist() == [[5, 2], [0, 0], [0, 0]] and N.gather("sum", h, s, d, 3).tolist() == [[8, 2], [0, 0], [0, 0]]
    with pytest.raises(ValueError):
        N.EncoderSpec(conv="none")
