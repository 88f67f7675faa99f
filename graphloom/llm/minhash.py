"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, bands, and exact weighted Jaccard similarity."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.collisions import forest
from graphloom.llm.common import components, drop_stage, smallest, stage
from graphloom.llm.quality import _SPACE, chunks

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 3
SAMPLES = BANDS * ROWS
#: Inverse document frequency ends at this share of the documents: rarer shingles weigh alike, so the table of others has at most 1 / DF_FLOOR rows for each distinct shingle of a mean document, however many documents there are.
DF_FLOOR = 0.001
#: Shingles that a task sorts and counts at once.
COUNTED = 1 << 21
#: Bytes of text to one range of shingles, on average: one task adds up what all others counted in a range.
RANGE_BYTES = 8_000_000
#: How much a rare shingle weighs above one of every document.
IDF_GAIN = 0.25
#: Of SAMPLES equal samples, pairs with fewer are not compared: at similarity 0.8 one pair in some thousands.
LEAST_EQUAL = SAMPLES // 2
#: Texts and bytes in a block of a large cluster, on average.
BLOCK, BLOCK_BYTES = 400, 1_500_000
DOC_BITS = 10
_U = np.uint64
_LOW = _U((1 << (64 - DOC_BITS)) - 1)
_RNG = np.random.default_rng(20240911)
_MIX = _RNG.integers(1, 1 << 62, size=256, dtype=np.uint64) | _U(1)
_PLACE = _RNG.integers(1, 1 << 62, size=64, dtype=np.uint64) | _U(1)
_STEP = _RNG.integers(1, 1 << 62, size=WIDTH, dtype=np.uint64) | _U(1)
_SALT = _RNG.integers(1, 1 << 62, size=(SAMPLES, 2), dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(raw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the bytes of up to 2**DOC_BITS lower-cased texts: text number, shingle and count, sorted by text and shingle. A text of fewer than WIDTH words is one shingle; one without words has none."""
    gap = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    a, b = edge[0::2], edge[1::2]
    n = len(a)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
    place = np.arange(len(raw)) - np.repeat(np.concatenate(([0], a)), np.diff(np.concatenate(([0], a, [len(raw)]))))
    word = _mixed(np.add.reduceat(np.where(gap, _U(0), _MIX[raw] * _PLACE[place & 63] + (place >> 6).astype(_U)), a))
    doc = np.searchsorted(first, a, "right") - 1
    h = np.zeros(n, _U)
    for k in range(min(WIDTH, n)):
        inside = np.zeros(n, bool)
        inside[: n - k] = doc[k:] == doc[: n - k]
        h += np.where(inside, np.roll(word, -k) * _STEP[k], _U(0))
    many = np.bincount(doc, minlength=len(first))
    rank = np.arange(n) - np.repeat(np.cumsum(many) - many, many)
    whole = (rank == 0) | (rank + WIDTH <= many[doc])
    key = np.sort((_mixed(h[whole]) & _LOW) | (doc[whole].astype(_U) << _U(64 - DOC_BITS)))
    new = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    count = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> _U(64 - DOC_BITS)).astype(np.int64), key & _LOW, count


class Rarity(NamedTuple):
    """Inverse document frequency weights: those of common shingles (sorted), and the one of all others."""

    common: np.ndarray
    weight: np.ndarray
    rest: float

    @classmethod
    def of(cls, common: np.ndarray, df: np.ndarray, n_docs: int) -> Rarity:
        """1 + IDF_GAIN ln(n / df) / ln(1 / DF_FLOOR), with df at least DF_FLOOR n and 1."""
        least = max(1.0, DF_FLOOR * n_docs)
        weigh = lambda x: 1 + IDF_GAIN * np.log(max(n_docs, 1) / np.clip(x, least, max(n_docs, 1))) / -np.log(DF_FLOOR)
        order = np.argsort(common)
        return cls(common[order], weigh(df[order].astype(np.float64)), float(weigh(least)))


def weights(shingle: np.ndarray, count: np.ndarray, idf: Rarity) -> np.ndarray:
    """Counts times inverse document frequencies."""
    if not len(idf.common):
        return count * idf.rest
    at = np.minimum(np.searchsorted(idf.common, shingle), len(idf.common) - 1)
    return count * np.where(idf.common[at] == shingle, idf.weight[at], idf.rest)


def samples(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Consistent weighted samples (n texts, SAMPLES) as 32-bit numbers: two texts agree in one with the chance of their weighted Jaccard similarity. Texts without shingles have zeros.

    For shingle s and sample k: r and c are Gamma(2,1) and beta uniform, drawn from (s, k); t = floor(ln w / r + beta),
    y = exp(r (t - beta)); the sample is (s, t) of the least c / (y exp r).
    """
    out = np.zeros((n, SAMPLES), np.int32)
    if not len(doc):
        return out
    heads = np.flatnonzero(np.diff(doc, prepend=-1))
    many = np.diff(np.append(heads, len(doc)))
    log_w = np.log(weight)
    scale = 2.0**-32
    for k in range(SAMPLES):
        x, z = _mixed(shingle ^ _SALT[k, 0]), _mixed(shingle ^ _SALT[k, 1])
        r = -np.log(((x >> _U(32)).astype(np.float64) + 0.5) * ((x & _U(0xFFFFFFFF)).astype(np.float64) + 0.5) * (scale * scale))
        c = -np.log(((z >> _U(40)).astype(np.float64) + 0.5) * (((z >> _U(20)) & _U(0xFFFFF)).astype(np.float64) + 0.5) * 2.0**-44)
        beta = (z & _U(0xFFFFF)).astype(np.float64) * 2.0**-20
        t = np.floor(log_w / r + beta)
        value = np.log(c) - r * (t - beta) - r
        least = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, heads), many))
        at = least[np.searchsorted(least, heads)]
        out[doc[heads], k] = (_mixed(shingle[at] + t[at].astype(np.int64).view(_U) * _U(0x9E3779B97F4A7C15)) >> _U(32)).astype(np.uint32).view(np.int32)
    return out


def _lowered(batch: pa.RecordBatch):
    """Chunks of lower-cased texts, few enough for shingles()."""
    for at in range(0, batch.num_rows, 1 << DOC_BITS):
        part = batch.slice(at, 1 << DOC_BITS)
        low = pa.RecordBatch.from_arrays([part.column(0), pa.array([(t or "").lower() for t in part.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])
        for a, b, raw, first in chunks(low):
            yield part.slice(a, b - a), raw, first


def document_frequencies(texts: DataFrame) -> Rarity:
    """Weights of shingles by the exact number of rows that have them, over all rows of texts (doc_id, text).

    Tasks count their own shingles first, so a shingle of every document is a few entries a task, and send them packed,
    by ranges of shingles; a range's number of entries is bounded for any corpus. Only shingles in more than DF_FLOOR of the rows come
    to the driver: fewer than 1 / DF_FLOOR for each distinct shingle of a mean document.
    """
    size = texts.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n_docs, ranges = size.n, max(1, -(-(size.bytes or 0) // RANGE_BYTES))
    least = max(1.0, DF_FLOOR * n_docs)
    bounds = np.arange(1, ranges, dtype=_U) * ((_LOW + _U(1)) // _U(ranges))

    def count(batches):
        held, n = [], 0

        def flush():
            found, many = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for at in range(0, len(found), COUNTED):
                s, m = found[at : at + COUNTED], many[at : at + COUNTED].astype(np.uint32)
                edges = np.concatenate(([0], np.searchsorted(s, bounds), [len(s)]))
                some = np.flatnonzero(np.diff(edges))
                cuts = np.append(edges[some], len(s))
                cells = (pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((cuts * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in (s, m))
                yield pa.RecordBatch.from_arrays([pa.array(some), *cells], names=["range", "found", "many"])

        for batch in batches:
            for _, raw, first in _lowered(batch):
                held.append(shingles(raw, first)[1])
                n += len(held[-1])
                if n >= COUNTED:
                    yield from flush()
                    n = 0
        if held:
            yield from flush()

    def add(table: pa.Table) -> pa.Table:
        s, m = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table[name]]) for name, kind in (("found", _U), ("many", np.uint32)))
        order = np.argsort(s, kind="stable")
        s = s[order]
        heads = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        n = np.add.reduceat(m[order], heads, dtype=np.int64)
        keep = n > least
        return pa.table({"shingle": pa.array(s[heads[keep]].view(np.int64)), "n": pa.array(n[keep])})

    common = stage(texts.mapInArrow(count, "range bigint, found binary, many binary").groupBy("range").applyInArrow(add, "shingle bigint, n bigint"))
    rows = common.toPandas()
    drop_stage(common)
    return Rarity.of(rows["shingle"].to_numpy(np.int64).view(_U), rows["n"].to_numpy(np.int64), n_docs)


def similarity(a: str | None, b: str | None, idf: Rarity) -> float:
    """Weighted Jaccard similarity of two texts; 1 for two texts without words."""
    both = [(t or "").lower().encode("utf-8", "surrogatepass") for t in (a, b)]
    raw = np.frombuffer(both[0] + b"\n" + both[1] + b"\n", np.uint8)
    doc, s, count = shingles(raw, np.array([0, len(both[0]) + 1]))
    w = weights(s, count, idf)
    cut = np.searchsorted(doc, 1)
    _, i, j = np.intersect1d(s[:cut], s[cut:], assume_unique=True, return_indices=True)
    shared = np.minimum(w[:cut][i], w[cut:][j]).sum()
    total = w.sum() - shared
    return float(shared / total) if total > 0 else 1.0


def _equal(x, y):
    return F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda e: e))


def _agreeing(table: pa.Table) -> pa.Table:
    """Of two blocks of one bucket (the same if lo = hi): a spanning forest of their texts that agree in LEAST_EQUAL samples."""
    ids, block = table["doc_id"].to_numpy(), table["block"].to_numpy()
    sig = np.asarray(table["sig"].combine_chunks().flatten()).reshape(len(ids), SAMPLES)
    x, y = np.flatnonzero(block == table["lo"][0].as_py()), np.flatnonzero(block == table["hi"][0].as_py())
    equal = np.zeros((len(x), len(y)), np.int16)
    for k in range(SAMPLES):
        equal += sig[x, k][:, None] == sig[y, k]
    i, j = np.nonzero(equal >= LEAST_EQUAL)
    root = forest(x[i], y[j], len(ids)) if len(i) else np.arange(len(ids))
    some = np.flatnonzero(root != np.arange(len(ids)))
    return pa.table({"a": pa.array(ids[root[some]], pa.int64()), "b": pa.array(ids[some], pa.int64())})


def _ties(members: DataFrame, rounds: int = 2) -> DataFrame:
    """Edges (a, b) between texts of one bucket that agree in LEAST_EQUAL samples, as few as hold each bucket's similar texts together.

    The smallest text of a bucket meets all others; those that it doesn't resemble choose their smallest for the next
    round, which meets all of the bucket again. Where a bucket's texts are still in several components of these edges,
    texts of different components meet each other: small buckets in a join, large ones block by block, of which only a
    spanning forest comes out. So the edges' components are those of all agreeing pairs.
    """
    out, left = None, members
    for _ in range(rounds):
        lead = left.groupBy("key").agg(F.min("doc_id").alias("lead"))
        signs = left.join(lead, "key").where("doc_id = lead").select("key", "lead", F.col("sig").alias("lead_sig"))
        met = members.join(signs, "key").where("doc_id <> lead").where(_equal(F.col("sig"), F.col("lead_sig")) >= LEAST_EQUAL)
        met = stage(met.select("key", F.col("lead").alias("a"), F.col("doc_id").alias("b")))
        out = met if out is None else out.unionByName(met)
        told = met.select("key", F.col("b").alias("doc_id")).unionByName(lead.select("key", F.col("lead").alias("doc_id")))
        left = stage(left.join(told.distinct(), ["key", "doc_id"], "left_anti"))
    out = out.select("a", "b").distinct()
    now = stage(smallest(components(out)).select(F.col("node").alias("doc_id"), "component"))
    placed = members.select("key", "doc_id").join(now, "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("part"))
    apart = placed.groupBy("key").agg(F.min("part").alias("one"), F.max("part").alias("last"), F.ceil(F.count("*") / BLOCK).alias("blocks")).where("one < last")
    divided = stage(members.join(apart.select("key", "blocks"), "key").join(now, "doc_id", "left").select("key", "blocks", "doc_id", "sig", F.coalesce("component", "doc_id").alias("part")))
    few = divided.where("blocks = 1").drop("blocks")
    other = few.select("key", F.col("doc_id").alias("b"), F.col("sig").alias("y"), F.col("part").alias("other"))
    few = few.join(other, "key").where((F.col("doc_id") < F.col("b")) & (F.col("part") != F.col("other"))).where(_equal(F.col("sig"), F.col("y")) >= LEAST_EQUAL)
    many = divided.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    many = many.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    many = many.select("key", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "doc_id", "sig")
    many = many.groupBy("key", "lo", "hi").applyInArrow(_agreeing, "a bigint, b bigint")
    return out.unionByName(few.select(F.col("doc_id").alias("a"), "b")).unionByName(many).distinct()


def links_among(ids: np.ndarray, texts: list[str | None], idf: Rarity, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of texts with a weighted Jaccard similarity of at least `least`, by matrix products.

    A shingle that a text has n times is n features, so that shared features sum to the minima of counts; only features
    of two texts or more can be shared, and they are taken some thousand at a time.
    """
    doc, s, count, w = [], [], [], []
    for at in range(0, len(texts), 1 << DOC_BITS):
        part = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts[at : at + (1 << DOC_BITS)]]
        size = np.array([len(x) + 1 for x in part])
        d, h, c = shingles(np.frombuffer(b"\n".join([*part, b""]), np.uint8), np.cumsum(size) - size)
        doc.append(d + at)
        s.append(h)
        count.append(c)
    doc, s, count = np.concatenate(doc), np.concatenate(s), np.concatenate(count)
    one = weights(s, np.ones_like(count), idf)
    total = np.bincount(doc, one * count, len(texts))
    level = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    doc, s, w = np.repeat(doc, count), np.repeat(s, count), np.repeat(one, count)
    order = np.lexsort((s, level))
    doc, s, w, level = doc[order], s[order], w[order], level[order]
    heads = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (level[1:] != level[:-1]))) if len(s) else np.zeros(0, np.int64)
    many = np.diff(np.append(heads, len(s)))
    shared = np.flatnonzero(many > 1)
    both = np.zeros((len(texts), len(texts)))
    for at in range(0, len(shared), 2048):
        own = shared[at : at + 2048]
        rows = np.repeat(heads[own] - np.cumsum(many[own]) + many[own], many[own]) + np.arange(many[own].sum())
        matrix = np.zeros((len(texts), len(own)))
        matrix[doc[rows], np.repeat(np.arange(len(own)), many[own])] = 1
        both += (matrix * w[heads[own]]) @ matrix.T
    union = total[:, None] + total[None, :] - both
    return np.nonzero(np.triu(both >= (least - 1e-12) * union, 1) & (union > 0))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row a document: doc_id, class_id (the smallest doc_id of its class) and kept (it is that one).

    Classes are the connected components of links between texts with weighted Jaccard similarity of at least `least`.
    Equal texts are one class before anything is compared. Distinct texts that share one of BANDS bands of ROWS samples
    (at similarity 0.8, all but one pair in a thousand) and agree in LEAST_EQUAL samples make candidate clusters; all
    texts of a cluster are compared with each other exactly. A large cluster is dealt into blocks of bounded size and compared block
    by block in matrix products, which give back a spanning forest of the links, never pairs; so groups of thousands
    of near copies cost neither many rows nor one task.

    Null and empty texts are equal to each other and to nothing else; texts of fewer than five words are one shingle of
    all their words; rows with a null doc_id get a null class unless an equal text has an id; repeated rows are one
    document; other columns are ignored. A shingle's weight follows from the exact share of rows that have it, repeated
    rows and copies included, so it does not depend on the size of the corpus.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    idf = document_frequencies(texts)

    def sign(batches):
        for batch in batches:
            for part, raw, first in _lowered(batch):
                doc, s, count = shingles(raw, first)
                got = samples(doc, s, weights(s, count, idf), len(first))
                cuts = pa.array(np.arange(len(first) + 1) * SAMPLES, pa.int32())
                size = np.diff(np.append(first, len(raw)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.ListArray.from_arrays(cuts, pa.array(got.ravel())), pa.array(np.bincount(doc, minlength=len(first)) > 0), pa.array(size.astype(np.int64))], names=["doc_id", "same", "sig", "some", "bytes"])

    signed = stage(texts.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("same")).mapInArrow(sign, "doc_id bigint, same string, sig array<int>, some boolean, bytes bigint"))
    equal = signed.groupBy("same").agg(F.min("doc_id").alias("rep"))
    reps = signed.where("some and doc_id is not null").join(equal.select(F.col("rep").alias("doc_id")).where("doc_id is not null"), "doc_id").dropDuplicates(["doc_id"])
    reps = stage(reps.select("doc_id", "sig", "bytes"))
    bands = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.slice("sig", b * ROWS + 1, ROWS))))
    placed = reps.select("doc_id", "sig", bands.alias("key"))
    shared = placed.groupBy("key").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead < last").select("key")
    members = stage(placed.join(shared, "key"))
    clusters = stage(smallest(components(_ties(members))).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")))
    size = clusters.join(reps.select("doc_id", "bytes"), "doc_id").groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).alias("blocks"))
    dealt = stage(clusters.join(size, "cluster").select("doc_id", "cluster", "blocks"))
    found = texts.join(dealt, "doc_id").dropDuplicates(["doc_id"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    found = found.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    found = found.select("cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "doc_id", "text")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        ids = table["doc_id"].to_numpy()
        i, j = links_among(ids, table["text"].to_pylist(), idf, least)
        root = forest(i, j, len(ids)) if len(i) else np.arange(len(ids))
        some = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({"a": pa.array(ids[some], pa.int64()), "b": pa.array(ids[root[some]], pa.int64())})

    links = stage(found.groupBy("cluster", "lo", "hi").applyInArrow(compare, "a bigint, b bigint"))
    now = smallest(components(links))
    out = signed.select("doc_id", "same").join(equal, "same")
    out = out.join(now.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("class_id"))
    return out.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
