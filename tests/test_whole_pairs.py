"""Metrics of embeddings meet all pairs of vectors, whatever their ids."""

import duckdb
import numpy as np
import pytest

from graphloom.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Vectors of which few have an id divisible by 20, and those are unlike the others."""
    rng, at = np.random.default_rng(8), str(tmp_path_factory.mktemp("vectors"))
    rows = [(i, (rng.normal(size=4) * 0.4 + (i % 20 == 0)).round(3).tolist(), int(i % 20 == 0 or rng.integers(2))) for i in range(1, 70)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at, rows


def _pairs(rows):
    """(pattern, target, violation, whether labels agree)."""
    x = np.float32([r[1] for r in rows]).astype(float)
    v = (np.maximum(x[:, None] - x[None], 0) ** 2).sum(axis=2)
    return [(p[0], t[0], v[i, j], int(p[2] == t[2])) for i, p in enumerate(rows) for j, t in enumerate(rows)]


def _agrees(spark, at, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{at}/embeddings.parquet/*.parquet')")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = [tuple(r) for r in QUERIES[name](spark, at).select(*columns).collect()]
    np.testing.assert_allclose(np.array(sorted(got), float), np.array(sorted(want.fetchall()), float), rtol=0, atol=2e-6)
    return got


def test_auroc(spark, folder):
    at, rows = folder
    s = [(round(-v, 6), same) for *_, v, same in _pairs(rows)]
    pos, neg = np.array([x for x, y in s if y]), np.array([x for x, y in s if not y])
    ((got,),) = _agrees(spark, at, "auroc")
    assert got == pytest.approx(((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg)), abs=2e-6)


def test_avg_precision(spark, folder):
    at, rows = folder
    s = [(round(-v, 6), same) for *_, v, same in _pairs(rows)]
    score, same = np.array([x for x, _ in s]), np.array([y for _, y in s])
    ((got,),) = _agrees(spark, at, "avg_precision")
    assert got == pytest.approx(np.mean([same[score >= x].mean() for x, y in s if y]), abs=2e-6)


def test_margin_predict(spark, folder):
    at, rows = folder
    ((tp, fp, fn, tn, *_),) = _agrees(spark, at, "margin_predict")
    s = [(v <= 0.8, bool(same)) for *_, v, same in _pairs(rows)]
    assert (tp, fp, fn, tn) == tuple(s.count(x) for x in ((True, True), (True, False), (False, True), (False, False)))
    assert tp + fp + fn + tn == len(rows) ** 2


def test_mean_value_score(spark, folder):
    at, rows = folder
    got = dict(_agrees(spark, at, "mean_value_score"))
    s = _pairs(rows)
    assert got == {r[0]: pytest.approx(1 - np.log(np.mean([v for p, _, v, _ in s if p == r[0]]) + 1), abs=2e-6) for r in rows}


def test_order_loss(spark, folder):
    at, rows = folder
    ((got,),) = _agrees(spark, at, "order_loss")
    assert got == pytest.approx(sum(v if same else max(0.0, 0.1 - v) for *_, v, same in _pairs(rows)), abs=2e-4)
