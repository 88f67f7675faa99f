"""Centroid clustering: plain Lloyd over integer vectors, exact from start to end."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import stage

SIZE = 64
SCALE = 64
#: Integers up to this size square and add up within 64 bits; larger ones are Python's own integers.
PLAIN = 1 << 27
LIMB = 40
LONG = (1 << 63) - 1


def whole(vectors: DataFrame, size: int = SIZE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id string, v array<double>) of the vectors with exactly `size` components, none null or non-finite. The id is a string so that pandas keeps its digits beside nulls."""
    v = vectors.select(F.col(f"`{id_col}`").cast("bigint").cast("string").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return v.where(F.col("v").isNotNull() & (F.size("v") == size) & ~F.coalesce(odd, F.lit(True)))


def integers(v: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of doubles: 64-bit where all are within PLAIN, else Python's integers, exact at any size."""
    scaled = np.floor(np.where(np.abs(v) < 2.0**60, v, 0) * SCALE)
    if v.size == 0 or np.abs(v).max() * SCALE < PLAIN:
        return scaled.astype(np.int64)
    return np.array([[int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE) for x in row] for row in v.tolist()], dtype=object).reshape(v.shape)


def parts(v: np.ndarray):
    """Slices of a batch's integers, rows within PLAIN and the others apart, each with the rows' places."""
    large = np.abs(v).max(axis=1, initial=0) * SCALE >= PLAIN
    for of in (~large, large):
        if of.any():
            yield np.flatnonzero(of), integers(v[of])


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """For each row its nearest centroid, the smaller number of equally near ones, and the squared distance."""
    if x.dtype == object or any(abs(c) >= PLAIN for row in centroids for c in row):
        x, kind = x.astype(object), object
    else:
        kind = np.int64
    d = np.stack([((x - np.array(c, dtype=kind)) ** 2).sum(axis=1) for c in centroids])
    at = np.argmin(d, axis=0)
    return at.astype(np.int32), d[at, np.arange(len(x))]


def start(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors of least sha256 of seed:vec_id, in that order; rows of one vec_id in the order of their components. Vectors without an id start none."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), "vec_id"), 256)
    rows = vectors.where("vec_id is not null").select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return [[int(c) for c in integers(np.array([r.v]))[0]] for r in rows]


def moved(vectors: DataFrame, centroids: list[list[int]], size: int) -> list[list[int]]:
    """Centroids after one round: floor(sum / count) of their vectors, those without vectors as they were.

    A partition sends one row of integer sums for each centroid that it met (and one for each 40 bits of sums of large
    integers), so what is shuffled is bounded by partitions x centroids and the driver gets a row a centroid.
    """
    names = [f"s{j}" for j in range(size)]

    def run(batches):
        total: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            if len(batch):
                for _, x in parts(np.stack(batch["v"].to_numpy())):
                    at, _ = nearest(x, centroids)
                    for c in np.unique(at):
                        n, s = total.get(int(c), (0, 0))
                        total[int(c)] = n + int((at == c).sum()), s + x[at == c].sum(axis=0).astype(object)
        rows = []
        for c, (n, s) in total.items():
            limb = 0
            while True:
                small = all(-LONG >> 16 <= int(t) <= LONG >> 16 for t in s)  # the rest fits one limb
                rows.append([c, limb, n if limb == 0 else 0, *(int(t) if small else int(t) & ((1 << LIMB) - 1) for t in s)])
                if small:
                    break
                s, limb = s >> LIMB, limb + 1
        yield pd.DataFrame(rows, columns=["cluster", "limb", "n", *names])

    sums = vectors.mapInPandas(run, "cluster int, limb int, n bigint, " + ", ".join(f"{c} bigint" for c in names))
    out, sizes = {}, {}
    for r in sums.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names)).collect():
        sizes[r.cluster] = sizes.get(r.cluster, 0) + r.n
        out[r.cluster] = [a + (r[c] << (LIMB * r.limb)) for a, c in zip(out.get(r.cluster, [0] * size), names, strict=True)]
    return [[t // sizes[c] for t in out[c]] if c in out else old for c, old in enumerate(centroids)]


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = SIZE, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per kept vector: vec_id, cluster int, distance long (squared, to its final centroid), cluster_inertia and inertia long, centroid_sha256 string.

    Kept are vectors with exactly `size` components, none null or non-finite; all others, and null vectors, give no row. A
    null vec_id is kept and assigned but starts no centroid; repeated rows are vectors like others. Fewer than k vectors
    with an id: as many centroids as there are; none: no rows. Components of any finite size are exact; a distance or
    inertia beyond a long is the largest long. Other columns are ignored. A round is one pass over the vectors.
    """
    spark, kept = vectors.sparkSession, whole(vectors, size, id_col, vector_col)
    centroids = start(kept, k, seed)
    if not centroids:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(kept, centroids, size)

    def run(batches):
        for batch in batches:
            at, d = np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int64)
            if len(batch):
                for rows, x in parts(np.stack(batch["v"].to_numpy())):
                    near, far = nearest(x, centroids)
                    at[rows], d[rows] = near, [min(int(y), LONG) for y in far]
            yield pd.DataFrame({"vec_id": batch["vec_id"].astype(object), "cluster": at, "distance": d})

    assigned = stage(kept.mapInPandas(run, "vec_id string, cluster int, distance bigint").select(F.col("vec_id").cast("bigint").alias("vec_id"), "cluster", "distance"))
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)  # noqa: E731  k literals
    totals = of([min(sums.get(c, 0), LONG) for c in range(len(centroids))]).cast("bigint")
    return assigned.select("vec_id", "cluster", "distance", totals.alias("cluster_inertia"), F.lit(min(sum(sums.values()), LONG)).cast("bigint").alias("inertia"), of(digest).alias("centroid_sha256"))


def _sql(k: int = 16, rounds: int = 3, size: int = SIZE) -> str:
    def assign(i: int) -> str:
        return f"""a{i} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(w) AS w, (min(d * {k} + cluster) % {k})::INT AS cluster, (min(d * {k} + cluster) // {k})::BIGINT AS distance
FROM (SELECT r, vec_id, w, cluster, list_sum(list_transform(list_zip(w, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS d FROM kept, c{i}) GROUP BY r)"""

    steps = []
    for i in range(rounds):
        steps.append(assign(i))
        steps.append(f"""m{i} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY j) AS m FROM (SELECT cluster, j, sum(w[j]) AS s, count(*) AS n FROM a{i}, range(1, {size + 1}) t(j) GROUP BY cluster, j) GROUP BY cluster),
c{i + 1} AS (SELECT cluster, coalesce(m::BIGINT[], c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))""")
    steps.append(assign(rounds))
    return f"""WITH kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS w FROM embeddings
WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), w) - 1 AS cluster, w AS c FROM kept WHERE vec_id IS NOT NULL QUALIFY cluster < {k}),
{("," + chr(10)).join(steps)}
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""


SQL = _sql()
