"""Graph views over the driver's tables, and the same views as SQL for oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAG = 10**12
#: Vertex kinds by tag: (label, table, key, finer label).
KINDS = (("region", "region", "r_regionkey", None), ("nation", "nation", "n_nationkey", None), ("customer", "customer", "c_custkey", "c_mktsegment"), ("supplier", "supplier", "s_suppkey", None), ("part", "part", "p_partkey", "p_brand"), ("order", "orders", "o_orderkey", None))
#: Edge kinds: (type, table, tag and key of the source, tag and key of the target, whether rows repeat).
LINKS = (
    ("in_region", "nation", (2, "n_nationkey"), (1, "n_regionkey"), False),
    ("in_nation", "customer", (3, "c_custkey"), (2, "c_nationkey"), False),
    ("in_nation", "supplier", (4, "s_suppkey"), (2, "s_nationkey"), False),
    ("placed", "orders", (3, "o_custkey"), (6, "o_orderkey"), False),
    ("contains", "lineitem", (6, "l_orderkey"), (5, "l_partkey"), True),
    ("shipped_by", "lineitem", (6, "l_orderkey"), (4, "l_suppkey"), True),
    ("supplied_by", "lineitem", (5, "l_partkey"), (4, "l_suppkey"), True),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, detail): regions, nations, customers, suppliers, parts, orders."""
    parts = [table(spark, sf_dir, t).select((F.col(k).cast("long") + F.lit(tag * TAG)).alias("id"), F.lit(label).alias("label"), (F.col(d) if d else F.lit(None)).cast("string").alias("detail")) for tag, (label, t, k, d) in enumerate(KINDS, 1)]
    return reduce(DataFrame.unionAll, parts)


def star_edges(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    """(src, dst, type), distinct; repeats: as the rows come, for what drops repeats itself. A filter on type prunes the branches of the union that can't have it."""
    parts = []
    for kind, t, (st, s), (dt, d), many in LINKS:
        e = table(spark, sf_dir, t).select(F.col(s).cast("long").alias("a"), F.col(d).cast("long").alias("b"))
        e = e.distinct() if many and not repeats else e
        parts.append(e.select((F.col("a") + F.lit(st * TAG)).alias("src"), (F.col("b") + F.lit(dt * TAG)).alias("dst"), F.lit(kind).alias("type")))
    return reduce(DataFrame.unionAll, parts)


def cop_edges(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    """Parts ordered together: (src, dst, type), src < dst, distinct; repeats: as orders have them, for what drops repeats itself."""
    # dealt once by order: distinct and both sides of the join read the same shuffle
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").repartition("l_orderkey").distinct()
    e = x.join(x.select("l_orderkey", F.col("l_partkey").alias("q")), "l_orderkey").where("l_partkey < q").select(F.col("l_partkey").alias("src"), F.col("q").alias("dst"), F.lit(None).cast("string").alias("type"))
    return e if repeats else e.distinct()


def cop_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"))


SQL_SV = "sv AS (" + " UNION ALL ".join(f"SELECT {tag * TAG} + CAST({k} AS BIGINT) AS id, '{label}' AS label, {d or 'CAST(NULL AS VARCHAR)'} AS detail FROM {t}" for tag, (label, t, k, d) in enumerate(KINDS, 1)) + ")"
SQL_SE = "se AS (" + " UNION ALL ".join(f"SELECT {'DISTINCT ' if many else ''}{st * TAG} + CAST({s} AS BIGINT) AS src, {dt * TAG} + CAST({d} AS BIGINT) AS dst, '{kind}' AS type FROM {t}" for kind, t, (st, s), (dt, d), many in LINKS) + ")"
SQL_COP = "cop AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)"
SQL_ADJ = "adj AS (SELECT src AS id, dst AS nbr FROM cop UNION SELECT dst, src FROM cop)"
SQL_SADJ = "sadj AS (SELECT src AS id, dst AS nbr FROM se WHERE src <> dst UNION SELECT dst, src FROM se WHERE src <> dst)"
