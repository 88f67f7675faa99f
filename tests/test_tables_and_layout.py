import numpy as np

from graphloom.functions.tables import register_tables
from graphloom.sinks.layout import circular, counts_chart, spring


def test_table_functions(spark):
    register_tables(spark)
    rows = spark.sql("SELECT * FROM neighborhood(0L, array(0L, 1L, 2L), array(1L, 2L, 3L), 2, 10)").collect()
    assert [(r.id, r.depth) for r in rows] == [(0, 0), (1, 1), (2, 2)]
    assert len(spark.sql("SELECT * FROM neighborhood(0L, array(0L, 0L), array(1L, 2L), 1, 2)").collect()) == 2
    grown = spark.sql("SELECT * FROM greedy_trial(3, array('a', 'b', 'a'), array(0L, 1L), array(1L, 2L), 3)").collect()
    assert [r["size"] for r in grown] == [2, 3] and grown[-1].nodes == [0, 1, 2]


def test_layout():
    p = spring(4, [(0, 1), (1, 2), (2, 3)])
    assert p.shape == (4, 2) and np.isfinite(p).all() and np.linalg.norm(p[0] - p[1]) < np.linalg.norm(p[0] - p[3])
    assert circular(3).shape == (3, 2) and spring(1, []).shape == (1, 2)


def test_chart():
    assert "polyline" in counts_chart([(3, 10, 20, 30), (4, 100, 200, 400)], "a < b") and "no counts" in counts_chart([], "x")
