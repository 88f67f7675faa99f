"""Sources: every reader gives vertices(id, label) and edges(src, dst, type)."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph


def _from_edges(edges: DataFrame, directed: bool) -> PropertyGraph:
    e = edges.select("src", "dst", F.lit(None).cast("string").alias("type")).distinct()
    v = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.lit(None).cast("string").alias("label"))
    g = PropertyGraph(v, e, directed)
    return g if directed else g.undirected()


def edge_list(spark: SparkSession, path: str, sep: str = r"\s+", comment: str = "#", directed: bool = False) -> PropertyGraph:
    """A text file of edges: two numbers a line, split by sep (white space, a tab, a comma); blank lines and comments are skipped."""
    line = F.trim("value")
    parts = F.split(line, sep)
    rows = spark.read.text(path).where((line != "") & ~line.startswith(comment) & ~line.startswith("%"))
    pairs = rows.select(parts[0].try_cast("long").alias("src"), parts[1].try_cast("long").alias("dst")).where("src is not null and dst is not null")
    return _from_edges(pairs, directed)


def interchange(spark: SparkSession, data: dict, directed: bool | None = None) -> PropertyGraph:
    """A dict of nodes ((id, attributes) or id) and edges ((u, v, attributes) or (u, v)) on the driver: small graphs."""
    as_text = lambda d: {str(k): None if v is None else str(v) for k, v in (d or {}).items()}
    nodes = [(x[0], as_text(x[1])) if isinstance(x, tuple | list) else (x, {}) for x in data["nodes"]]
    edges = [(x[0], x[1], as_text(x[2] if len(x) > 2 else {})) for x in data["edges"]]
    v = spark.createDataFrame(nodes, "id long, attrs map<string,string>")
    e = spark.createDataFrame(edges, "src long, dst long, attrs map<string,string>")
    from graphloom.functions.scalar import EDGE_TYPE_KEYS, first_of, node_label

    g = PropertyGraph(v.select("id", node_label(F.col("attrs")).alias("label"), "attrs"), e.select("src", "dst", first_of(F.col("attrs"), EDGE_TYPE_KEYS).alias("type"), "attrs"), True)
    return g if (data.get("directed", True) if directed is None else directed) else PropertyGraph(g.vertices, g.undirected().edges, False)


def numbered_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, line, value): the lines of text files with their numbers from 1, blank ones included.

    Files are read in splits. Lines of a split come in order, so a line's place in its split is a difference of row numbers; a split starts at the
    sum of the lines of its file's splits before it, of which there is one row each. No task reads more than a split, and lines are not shuffled.
    """
    from pyspark.sql import Window

    text = spark.read.text(path, **({"pathGlobFilter": glob} if glob else {}))
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"), "value")
    splits = rows.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "split", (before - F.col("first") + 1).alias("shift"))
    return rows.join(starts, ["file", "split"]).select("file", (F.col("row") + F.col("shift")).alias("line"), "value")


def tu_collection(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A collection of graphs in the TU text layout: vertices(graph_id, id, label), edges(graph_id, src, dst), graphs(graph_id, label). Vertices are numbered by line, by file position."""
    numbered = lambda f, cols: numbered_lines(spark, f"{folder}/{name}_{f}.txt").where("trim(value) <> ''").select(F.col("line").alias("id"), F.trim("value").alias(cols))
    owner = numbered("graph_indicator", "g").select("id", F.col("g").cast("long").alias("graph_id"))
    try:
        labels = numbered("node_labels", "label")
    except AnalysisException:  # some collections have no such file
        labels = owner.select("id", F.lit(None).cast("string").alias("label")).limit(0)
    v = owner.join(labels, "id", "left").select("graph_id", "id", "label")
    pair = F.split("value", r",\s*")
    e = spark.read.text(f"{folder}/{name}_A.txt").where("trim(value) <> ''").select(F.trim(pair[0]).cast("long").alias("src"), F.trim(pair[1]).cast("long").alias("dst"))
    e = e.join(owner.select(F.col("id").alias("src"), "graph_id"), "src").select("graph_id", "src", "dst")
    return v, e, numbered("graph_labels", "label").withColumnRenamed("id", "graph_id")


#: Names of the collections and of their files.
COLLECTIONS = {"enzymes": "ENZYMES", "proteins": "PROTEINS", "cox2": "COX2", "aids": "AIDS", "reddit-binary": "REDDIT-BINARY", "imdb-binary": "IMDB-BINARY", "firstmm_db": "FIRSTMM_DB", "dblp": "DBLP_v1", "ppi": "PPI", "qm9": "QM9"}


def collection(spark: SparkSession, name: str, root: str = ".") -> tuple[DataFrame, DataFrame]:
    """vertices(graph_id, id, label) and edges(graph_id, src, dst) of a collection by name: files in the TU text layout in root/NAME, or `atlas`, which needs none. split_by_hash on graph_id gives training and test graphs."""
    if name == "atlas":
        return atlas(spark)
    if name not in COLLECTIONS:
        raise ValueError(f"{name} is none of {', '.join([*COLLECTIONS, 'atlas'])}")
    v, e, _ = tu_collection(spark, f"{root}/{COLLECTIONS[name]}", COLLECTIONS[name])
    return v, e


def atlas(spark: SparkSession, most: int = 7) -> tuple[DataFrame, DataFrame]:
    """All connected graphs of up to `most` vertices, one of each class: 996 up to seven. Each grows from one with a vertex less, by a vertex with some neighbours, and is known by its canonical code. Ids are unique over the atlas."""
    from graphloom.functions.canonical import canonical_code

    found, layer = [(1, [])], [(1, [])]
    for n in range(1, most):
        codes = {}
        for _, pairs in layer:
            for bits in range(1, 1 << n):
                grown = [*pairs, *((v, n) for v in range(n) if bits >> v & 1)]
                codes.setdefault(canonical_code(n + 1, [x for a, b in grown for x in ((a, b, ""), (b, a, ""))], [""] * (n + 1)), grown)
        layer = [(n + 1, pairs) for pairs in codes.values()]
        found += layer
    v = spark.createDataFrame([(g, 10 * g + i, None) for g, (n, _) in enumerate(found) for i in range(n)], "graph_id long, id long, label string")
    return v, spark.createDataFrame([(g, 10 * g + a, 10 * g + b) for g, (_, pairs) in enumerate(found) for a, b in pairs], "graph_id long, src long, dst long")


def first_graphs(vertices: DataFrame, n: int) -> DataFrame:
    """The vertices of the first n graphs of a collection, by graph_id."""
    keep = vertices.select("graph_id").distinct().orderBy("graph_id").limit(n)
    return vertices.join(keep, "graph_id", "left_semi")


def from_tables(nodes: DataFrame, relations: DataFrame) -> PropertyGraph:
    """A graph database's nodes(ext_id, labels array, custom_label) and relations(from_id, to_id, type), as a JDBC or other reader gives them: dense ids, the custom label, else the first one, else Node; relations in both directions are one edge."""
    label = F.coalesce("custom_label", F.try_element_at("labels", F.lit(1)), F.lit("Node"))
    v = dense_ids(nodes.select("ext_id", label.alias("label")), "ext_id")
    a, b = v.select(F.col("ext_id").alias("from_id"), F.col("id").alias("x")), v.select(F.col("ext_id").alias("to_id"), F.col("id").alias("y"))
    e = relations.join(a, "from_id").join(b, "to_id").select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), "type").groupBy("src", "dst").agg(F.min("type").alias("type"))
    return PropertyGraph(v.select("id", "ext_id", "label"), e, False)


def dense_ids(df: DataFrame, by: str) -> DataFrame:
    """df with id: 0, 1, ... in the order of a distinct column. Rows are numbered inside ranges, and a range's first number is the sum of those before it (one number a partition on the driver), so no task has all rows."""
    from pyspark.sql import Window

    from graphloom.operators.traverse import _cut

    ranged = _cut(df.repartitionByRange(by).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"), F.min(by).alias("low")).orderBy("low").collect()
    first, at = {}, 0
    for r in sizes:
        first[r["part"]], at = at, at + r["n"]
    if not first:
        return ranged.drop("part").withColumn("id", F.lit(0).cast("long"))
    start = F.element_at(F.create_map(*(F.lit(x) for kv in first.items() for x in kv)), F.col("part"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(by)) - 1
    return ranged.withColumn("id", (start + rank).cast("long")).drop("part")


def graph_files(spark: SparkSession, folder: str, glob: str = "*.txt", sep: str = r"\s+") -> DataFrame:
    """(graph_id, src, dst) of a folder with one edge list a graph; graph_id is the file's stem."""
    parts = F.split(F.trim("value"), sep)
    rows = spark.read.text(folder, pathGlobFilter=glob).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1).alias("graph_id"), parts[0].try_cast("long").alias("src"), parts[1].try_cast("long").alias("dst"))
    return rows.where("src is not null and dst is not null")


def read_through(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at path; where there is none, build() is written there first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        build().write.parquet(path)
        return spark.read.parquet(path)


def label_file(spark: SparkSession, path: str) -> DataFrame:
    """Labels, one a line; # begins a comment line."""
    t = F.trim("value")
    return spark.read.text(path).select(t.alias("label")).where((F.col("label") != "") & ~F.col("label").startswith("#")).distinct()


def label_arguments(spark: SparkSession, text: str) -> DataFrame:
    """Labels of a comma-separated argument."""
    return spark.createDataFrame([(text,)], "t string").select(F.explode(F.split("t", ",")).alias("label")).select(F.trim("label").alias("label")).where("label <> ''").distinct()


def count_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, size, n) of all count files [sizes, counts, []] in a folder; name is the file's stem."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("name"), F.from_json("value", "array<array<double>>").alias("c"))
    return raw.select("name", F.explode(F.arrays_zip(F.col("c")[0].alias("size"), F.col("c")[1].alias("n"))).alias("z")).select("name", F.col("z")["size"].cast("int").alias("size"), F.col("z")["n"].alias("n"))


def patterns_json(text: str) -> list[dict]:
    """Patterns of a JSON text, each checked for nodes and edges."""
    data = json.loads(text)
    for p in data:
        if p.get("type") != "graph_context" and not ({"nodes", "edges"} <= p.keys()):
            raise ValueError("a pattern needs nodes and edges")
    return data


def resolve_metadata(args: dict, sidecar: dict, given: set[str] = frozenset()) -> dict:
    """A model's metadata over defaults; raises where an argument was given and differs."""
    out = dict(args)
    for k, v in sidecar.get("args", sidecar).items():
        if k in given and args.get(k) != v:
            raise ValueError(f"{k}: {args.get(k)!r} was asked for, the model has {v!r}")
        out[k] = v
    return out


def split_by_hash(df: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of the key: the same rows on every cluster, without a sort."""
    u = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(share * 1_000_000)
    return df.where(u), df.where(~u)
