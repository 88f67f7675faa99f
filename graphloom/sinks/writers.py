"""Sinks: JSON of patterns, instances and counts; display payloads."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalar import density
from graphloom.operators.traverse import _cut


def _with_attributes(own: Column, attrs: Column, keys: tuple[str, ...]) -> Column:
    """The JSON object of a struct with the entries of a map behind it, less those under the struct's own keys."""
    more = F.to_json(F.map_filter(attrs, lambda k, v: ~k.isin(*keys) & v.isNotNull()))
    return F.when(attrs.isNull() | (more == "{}"), F.to_json(own)).otherwise(F.concat(F.regexp_replace(F.to_json(own), r"\}$", ","), F.substring(more, 2, 1 << 30)))


def pattern_json(nodes: DataFrame, edges: DataFrame, directed: bool = True) -> DataFrame:
    """(pattern, json) of nodes(pattern, id, label, anchor[, attrs]) and edges(pattern, src, dst, type[, attrs]): nodes, edges and metadata of one pattern a row. Entries of attrs, a map, are passed through as further keys."""

    def listed(df: DataFrame, own: list[Column], keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
        one = F.struct(*own)
        text = _with_attributes(one, F.col("attrs"), keys) if "attrs" in df.columns else F.to_json(one)
        rows = df.select("pattern", F.struct(*order, text.alias("json")).alias("x"))
        return rows.groupBy("pattern").agg(F.array_sort(F.collect_list("x")).alias("x")).select("pattern", F.concat(F.lit("["), F.array_join("x.json", ","), F.lit("]")).alias("json"), F.size("x").alias("n"))  # a pattern's own

    v = listed(nodes, [F.col("id"), F.col("label"), F.col("anchor")], ("id", "label", "anchor"), ("id", "label", "anchor"))
    e = listed(edges, [F.col("src").alias("source"), F.col("dst").alias("target"), F.col("type")], ("source", "target", "type"), ("src", "dst", "type"))
    j = v.join(e.select("pattern", F.col("json").alias("edges"), F.col("n").alias("m")), "pattern", "left")
    meta = F.to_json(F.struct(F.col("n").alias("num_nodes"), F.coalesce("m", F.lit(0)).alias("num_edges"), F.lit(directed).alias("is_directed")))
    return j.select("pattern", F.concat(F.lit('{"nodes":'), "json", F.lit(',"edges":'), F.coalesce("edges", F.lit("[]")), F.lit(',"metadata":'), meta, F.lit("}")).alias("json"))


def instances_json(patterns: DataFrame, context: DataFrame) -> DataFrame:
    """One text a row: the dataset's totals first, then patterns by key. patterns: (pattern_key, json)."""
    head = context.select(F.lit(0).alias("o"), F.lit("").alias("pattern_key"), F.to_json(F.struct(F.lit("graph_context").alias("type"), F.struct(*context.columns).alias("data"))).alias("json"))
    return head.unionByName(patterns.select(F.lit(1).alias("o"), "pattern_key", "json")).orderBy("o", "pattern_key").select("json")


def counts_json(counts: DataFrame) -> str:
    """[sizes, counts, []] of (pattern, size, n): one number a query pattern, so it fits the driver."""
    rows = counts.orderBy("pattern").collect()
    return json.dumps([[r["size"] for r in rows], [r["n"] for r in rows], []])


def payload(title: Column, directed: bool) -> tuple[Column, Column]:
    """Of columns nodes and edges (arrays): metadata and legend of a display payload."""
    n, m = F.size("nodes"), F.size("edges")
    meta = F.struct(title.alias("title"), n.alias("nodeCount"), m.alias("edgeCount"), F.lit(directed).alias("isDirected"), F.round(density(n, m, directed), 6).alias("density"))
    legend = F.struct(F.array_sort(F.array_distinct(F.transform("nodes", lambda x: x["label"]))).alias("nodeTypes"), F.array_sort(F.array_distinct(F.transform("edges", lambda x: x["type"]))).alias("edgeTypes"))
    return meta, legend


def check_payload(data: dict) -> list[str]:
    """What is wrong with a display payload; nothing if it can be shown."""
    wrong = [f"no {k}" for k in ("metadata", "nodes", "edges", "legend") if k not in data]
    ids = {x.get("id") for x in data.get("nodes", [])}
    wrong += [f"edge {e.get('source')}-{e.get('target')} has no such end" for e in data.get("edges", []) if e.get("source") not in ids or e.get("target") not in ids]
    return wrong + (["no nodes"] if not data.get("nodes") else [])


def page(template: str, data: dict, marker: str = "const GRAPH_DATA") -> str:
    """A template with the payload in place of its data line; raises if the template lacks what it needs."""
    for need in ("<script", marker, "</script>"):
        if need not in template:
            raise ValueError(f"the template lacks {need}")
    start = template.index(marker)
    end = template.index(";", start)
    return template[:start] + f"{marker} = " + json.dumps(data, ensure_ascii=False).replace("</", "<\\/") + template[end:]


def index_page(names: list[str]) -> str:
    from html import escape

    items = "\n".join(f'<li><a href="{escape(n)}">{escape(n)}</a></li>' for n in sorted(names))
    return f"<!DOCTYPE html><html><body><ul>\n{items}\n</ul></body></html>"


def run_resumable(tasks: DataFrame, work, folder: str, key: str = "task", batches: int = 8) -> DataFrame:
    """Results of work(tasks) over batches of tasks, kept in folder/done; a run that was stopped goes on with what has no result yet.

    work gives rows with the key and a column error (null where it succeeded). A task with an error goes to folder/bad
    and is not tried again. Batches are shares of the keys' hashes; each is written whole or not at all.
    """
    spark = tasks.sparkSession
    for k in range(batches):
        left = tasks.where(F.pmod(F.xxhash64(key), F.lit(batches)) == k)
        for name in ("done", "bad"):
            known = table_if_any(spark, f"{folder}/{name}")
            left = left if known is None else left.join(known.select(key), key, "left_anti")
        if left.isEmpty():
            continue
        got = _cut(work(left))  # computed once for both tables
        got.where("error is null").drop("error").write.mode("append").parquet(f"{folder}/done")
        got.where("error is not null").select(key, "error").write.mode("append").parquet(f"{folder}/bad")
    done = table_if_any(spark, f"{folder}/done")
    return work(tasks.limit(0)).drop("error") if done is None else done  # no tasks, no results


def own_folder(spark) -> str:
    """A new folder beside the checkpoints, which driver and executors share."""
    _cut(spark.range(0))  # sets a checkpoint folder where there is none
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/runs/{uuid.uuid4().hex}"


def table_if_any(spark, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def append_metrics(spark, folder: str, run: str, step: int, values: dict[str, float]) -> None:
    """Adds one row (run, step, name, value) a metric to a table; read it back and pivot it for curves."""
    spark.createDataFrame([(run, step, k, float(v)) for k, v in values.items()], "run string, step int, name string, value double").coalesce(1).write.mode("append").parquet(folder)


def beam_dump(found: DataFrame, folder: str) -> None:
    """The sets that a beam kept, with size, score and support, by size: what an analysis of the search reads."""
    found.write.mode("overwrite").partitionBy("size").parquet(folder)
