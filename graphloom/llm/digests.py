"""The columns that the span operators' queries derive from found spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def span_digest(found: DataFrame, base: tuple[str, ...]) -> DataFrame:
    """Of rows (doc_id, found array<struct<kind,start,end,...>>, already sorted): counts by base kind, the hash of base spans, all spans."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    strong = F.filter("found", lambda x: x["kind"].isin(*base))
    counts = [F.size(F.filter("found", lambda x: x["kind"] == F.lit(k))).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(joined(strong), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
