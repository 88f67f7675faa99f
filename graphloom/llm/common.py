"""What several operators of this subpackage share: tables in the shared folder, and connected components."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one made here where it is unset (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Makes Spark drop a query's shuffle files as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stage(df: DataFrame, batch_rows: int | None = None, **options: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: cuts the lineage, survives lost executors, keeps column pruning and size statistics. The write's shuffle files go when it has ended. batch_rows: rows that Python gets at once, for rows of megabytes; options go to the writer."""
    conf = df.sparkSession.conf
    path = f"{shared_dir(df.sparkSession)}/graphloom/{uuid.uuid4().hex}"
    own = {CLEANUP: "true"} | ({BATCH: str(batch_rows)} if batch_rows else {})
    before = {k: conf.get(k) for k in own}
    try:
        for k, v in own.items():
            conf.set(k, v)
        df.write.options(**options).parquet(path)
    finally:
        for k, v in before.items():
            conf.set(k, v)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_stage(df: DataFrame) -> None:
    """Deletes a table of stage() that nothing reads any more."""
    path = getattr(df, "_staged_at", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of the graph of edges (long columns a, b): rows (node, root) for each node of an edge.

    Contraction: each node hooks onto its neighbour of least hashed priority if that is less than its own, pointers
    jump once, edges are relabelled and made distinct. Random priorities keep pointer chains short and the number of
    rounds logarithmic for any shape (paths, stars). All joins meet a side with one row a node; the minimum of a hub's
    neighbours is pre-aggregated. Each round's tables are written to the shared folder. Null ends are ignored; no edges
    give no rows. root is a member of the component, the same for all its nodes.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    e = stage(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e, maps = e.where("u <> v"), []
    while not e.isEmpty():
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = both.groupBy("u").agg(F.min_by("v", F.xxhash64("v")).alias("m"))
        hu, hm = F.xxhash64("u"), F.xxhash64("m")
        hooks = (hm < hu) | ((hm == hu) & (F.col("m") < F.col("u")))
        once = stage(best.select(F.col("u").alias("node"), F.when(hooks, F.col("m")).otherwise(F.col("u")).alias("up")))
        twice = stage(once.join(once.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("up")))
        drop_stage(once)
        maps.append(twice)
        pu = twice.select(F.col("node").alias("u"), F.col("up").alias("pu"))
        pv = twice.select(F.col("node").alias("v"), F.col("up").alias("pv"))
        e = e.join(pu, "u").join(pv, "v").where("pu <> pv")
        e = stage(e.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
    if not maps:
        return nodes.select("node", F.col("node").alias("root"))
    out = maps[-1].select("node", F.col("up").alias("root"))
    for up in reversed(maps[:-1]):
        later = out.select(F.col("node").alias("up"), "root")
        out = up.join(later, "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    loops = nodes.join(out.select("node"), "node", "left_anti")
    return out.unionByName(loops.select("node", F.col("node").alias("root")))


def smallest(roots: DataFrame) -> DataFrame:
    """Of components(): rows (node, component) with the smallest node of each component."""
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    return roots.join(least, "root").select("node", "component")


def per_text(docs: DataFrame, fn, returns: str, name: str, id_col: str = "doc_id", text_col: str = "text", rows: int = 512) -> DataFrame:
    """Rows (doc_id, name) with fn(text) of each row, as the DDL type `returns`; in Arrow batches, a slice of `rows` at a time. Nulls stay nulls in doc_id and reach fn as None."""

    kind = to_arrow_type(DataType.fromDDL(returns))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fn(t) for t in part.column(1).to_pylist()], type=kind)], names=["doc_id", name])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, f"doc_id bigint, {name} {returns}")
