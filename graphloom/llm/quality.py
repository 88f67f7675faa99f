"""Quality classifier: random-indexing word vectors pooled over a document, and a two-layer network with calibrated probabilities."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
DIMS = 32
REACH = 2
#: At most so many labelled rows are fitted, those of least hashed doc_id.
FIT_ROWS = 20_000
CHUNK = 1 << 21

_KIND = np.zeros(256, np.uint8)  # class of a byte, for word shapes
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[128:] = 1
for _c in b".,;:!?'\"()-":
    _KIND[_c] = 4
_KIND[ord("!")] = 5
for _c in b"#$%&*+/<=>@[\\]^_`{|}~":
    _KIND[_c] = 6
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MIX = np.random.default_rng(20240901).integers(1, 1 << 62, size=256, dtype=np.uint64) | np.uint64(1)
_PLACE = np.random.default_rng(20240902).integers(1, 1 << 62, size=64, dtype=np.uint64) | np.uint64(1)


def index_vectors() -> np.ndarray:
    """A sparse ternary vector for each bucket of words: four ones, half of them negative."""
    rng = np.random.default_rng(20240903)
    out = np.zeros((BUCKETS, DIMS), np.float32)
    for row in out:
        row[rng.choice(DIMS, 4, replace=False)] = (1, 1, -1, -1)
    return out


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of UTF-8 bytes: starts and ends of the words between white space, each word's bucket and each word's shape (which classes of bytes it has, where it ends in, how long it is)."""
    gap = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    a, b = edge[0::2], edge[1::2]
    if not len(a):
        return a, b, a, a
    place = np.arange(len(raw)) - np.repeat(np.concatenate(([0], a)), np.diff(np.concatenate(([0], a, [len(raw)]))))
    h = np.add.reduceat(np.where(gap, np.uint64(0), _MIX[raw] * _PLACE[place & 63]), a)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    kinds = np.bitwise_or.reduceat(np.where(gap, 0, 1 << _KIND[raw].astype(np.int64)), a)
    size = np.minimum(np.log2(b - a).astype(np.int64), 5)
    shape = (kinds * 7 + _KIND[raw[b - 1]]) * 6 + size
    return a, b, (h % np.uint64(BUCKETS)).astype(np.int64), shape % BUCKETS


def chunks(batch: pa.RecordBatch):
    """Slices of a batch (doc_id, text) of about CHUNK bytes, one text at least: rows, their bytes joined by line breaks, where each text starts."""
    column = batch.column(1).cast(pa.large_string())
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0)) if batch.num_rows else np.zeros(0, int)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK)))
        texts = ["" if t is None else t for t in column.slice(at, end - at).to_pylist()]
        raw = np.frombuffer("\n".join([*texts, ""]).encode(), np.uint8)
        first = np.concatenate(([0], np.cumsum(sizes[at:end] + 1)[:-1]))
        yield at, end, raw, first
        at = end


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Context vectors (2, BUCKETS, DIMS) of words and of shapes: the sum of the index vectors of the words up to REACH places away, over all documents, at unit length.

    A task sums what it reads into an array of fixed size and sends on its rows, so the shuffle is bounded by tasks x
    2 x BUCKETS rows and the driver gets 2 x BUCKETS rows at most, whatever the corpus.
    """
    base = index_vectors()

    def run(batches):
        total = np.zeros((2, BUCKETS, DIMS))
        for batch in batches:
            for _, _, raw, first in chunks(batch):
                a, _, bucket, shape = words(raw)
                if not len(a):
                    continue
                doc = np.searchsorted(first, a, "right")
                for of, by in ((bucket, 0), (shape, 1)):
                    for d in range(DIMS):
                        near = np.zeros(len(a), np.float32)
                        v = base[of if by else bucket, d]
                        for k in range(1, REACH + 1):
                            same = doc[k:] == doc[:-k]
                            near[k:] += np.where(same, v[:-k], 0)
                            near[:-k] += np.where(same, v[k:], 0)
                        total[by, :, d] += np.bincount(of, near, BUCKETS)
        kept = np.argwhere(np.any(total, axis=2))
        if len(kept):
            yield pa.RecordBatch.from_arrays([pa.array(kept[:, 0] * BUCKETS + kept[:, 1]), *(pa.array(total[kept[:, 0], kept[:, 1], d]) for d in range(DIMS))], names=["k", *(f"d{d}" for d in range(DIMS))])

    sums = docs.selectExpr("cast(null as bigint) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, "k bigint, " + ", ".join(f"d{d} double" for d in range(DIMS)))
    rows = sums.groupBy("k").agg(*(F.sum(f"d{d}").alias(f"d{d}") for d in range(DIMS))).toPandas()
    out = np.zeros((2 * BUCKETS, DIMS))
    out[rows["k"].to_numpy(np.int64)] = rows.drop(columns="k").to_numpy()
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    own = np.concatenate([base, base])  # a word without neighbours keeps its index vector
    return np.where(norm > 0, out / np.maximum(norm, 1e-12) * 0.7 + own * 0.15, own * 0.3).reshape(2, BUCKETS, DIMS).astype(np.float32)


def features(vectors: np.ndarray, raw: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row for each text: its words' mean vector, its shapes' mean vector, and six sums about its words."""
    a, b, bucket, shape = words(raw)
    n = len(first)
    out = np.zeros((n, 2 * DIMS + 6), np.float32)
    doc = np.searchsorted(first, a, "right") - 1
    count = np.bincount(doc, minlength=n).astype(float)
    some = np.maximum(count, 1)
    for d in range(DIMS):
        out[:, d] = np.bincount(doc, vectors[0, bucket, d], n) / some
        out[:, DIMS + d] = np.bincount(doc, vectors[1, shape, d], n) / some
    pairs = np.unique(doc * BUCKETS + bucket)
    distinct = np.bincount(pairs // BUCKETS, minlength=n)
    lines = np.bincount(np.searchsorted(first, np.flatnonzero(raw == 10), "right") - 1, minlength=n)
    out[:, -6] = np.log1p(count) / 5
    out[:, -5] = distinct / some
    out[:, -4] = np.bincount(doc, b - a, n) / some / 8
    out[:, -3] = np.bincount(doc, (b - a) ** 2, n) / some / 100
    out[:, -2] = np.log1p(lines) / 3
    out[:, -1] = count == 0
    return out


@dataclass
class Network:
    """Two layers; probabilities are sigmoid(logit / temperature)."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 120, seed: int = 7) -> Network:
    """Adam on cross-entropy with weight decay; the temperature is the one of least loss on a fifth of the rows that the weights never saw. One class only, or no rows: a constant score."""
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    if len(y) < 10 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Network(vectors, np.zeros(width), np.ones(width), np.zeros((width, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(p / (1 - p))), 1.0)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -6, 6)
    order = rng.permutation(len(y))
    held, own = order[: len(y) // 5], order[len(y) // 5 :]
    p = [rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(epochs):
        own = rng.permutation(own)
        for at in range(0, len(own), 128):
            i = own[at : at + 128]
            h = np.tanh(z[i] @ p[0] + p[1])
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[i]) / len(i)
            back = np.outer(g, p[2]) * (1 - h * h)
            grads = [z[i].T @ back + 1e-3 * p[0], back.sum(0), h.T @ g + 1e-3 * p[2], np.array([g.sum()])]
            t += 1
            for k, d in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net = Network(vectors, mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    logit = net.logits(x[held])

    def loss(temp: float) -> float:
        q = np.clip(1 / (1 + np.exp(-np.clip(logit / temp, -30, 30))), 1e-9, 1 - 1e-9)
        return float(-(y[held] * np.log(q) + (1 - y[held]) * np.log(1 - q)).mean())

    net.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
    return net


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Network:
    """Word vectors from all documents; the network from at most `rows` labelled documents whose crc32(doc_id) mod 3 is not 1, those of least hashed doc_id. Labels that are null or name no document are ignored; a document labelled twice counts once, with its larger label."""
    vectors = word_vectors(docs)
    marked = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marked = marked.groupBy("doc_id").agg(F.max("quality").alias("quality")).where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marked), "doc_id")  # `rows` rows at most
    names = [f"x{i}" for i in range(2 * DIMS + 6)]

    def run(batches):
        for batch in batches:
            for at, end, raw, first in chunks(batch):
                x = features(vectors, raw, first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), batch.column(2).slice(at, end - at), *(pa.array(x[:, i]) for i in range(x.shape[1]))], names=["doc_id", "quality", *names])

    got = texts.select("doc_id", "text", "quality").mapInArrow(run, "doc_id bigint, quality int, " + ", ".join(f"{n} float" for n in names)).toPandas()
    got = got.sort_values(["doc_id", *names], ignore_index=True)
    return train(vectors, got[names].to_numpy(np.float64), got["quality"].to_numpy(np.float64))


def score_quality(docs: DataFrame, net: Network) -> DataFrame:
    """One row a document: doc_id, held_out, score (0 to 1), predicted. Only the text goes into a score: null and empty texts share one, a null doc_id is kept (not held out), repeated rows repeat, other columns are ignored."""

    def run(batches):
        for batch in batches:
            for at, end, raw, first in chunks(batch):
                ids = batch.column(0).slice(at, end - at)
                s = net.scores(features(net.vectors, raw, first))
                yield pa.RecordBatch.from_arrays([ids, pa.array([held_out(i) for i in ids.to_pylist()], pa.bool_()), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text scores 0.5 or more. Rows are judged where they are read, each by its own text, whatever its doc_id; no shuffle."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows), batch.column(at)], names=["doc_id", "text"])
            for a, b, raw, first in chunks(texts):
                good = net.scores(features(net.vectors, raw, first)) >= 0.5
                yield batch.slice(a, b - a).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
