"""Suffix-array dedup: bytes of strings that start in an earlier document too, by two-stage suffix sorting."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import stage

LENGTH = 50
#: Anchors are the least hashes of GRAM bytes among those inside a string of LENGTH bytes.
GRAM = 20
CHUNK = 1 << 21
#: Bytes of contexts that are sorted together, one anchor's whole group at least.
SORTED = 1 << 18
#: Anchors with more bytes of contexts are hot: their strings are dealt one by one.
HOT = 1 << 20
#: Runs that cover more bytes are hashed by BLAKE2: texts of 512 bytes and more can be made whose polynomial hashes modulo 2**64 are equal for every base.
PLAIN = 256
_U = np.uint64
_MASK = (1 << 64) - 1
_RNG = np.random.default_rng(20240921)
_BYTE = _RNG.integers(1, 1 << 62, size=256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def anchors(raw: np.ndarray, first: np.ndarray, size: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of strings of `length` bytes with one anchor value: text number, first string's place in its text, number of strings, anchor, hash of all bytes that the run's strings cover.

    Equal strings have equal anchors wherever they stand, so two equal strings are in runs of one anchor. Texts lie one
    after the other in raw, at first, size bytes each; no string crosses texts.
    """
    n = len(raw)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty.view(_U), empty.view(_U)
    if _CACHE.get("n", 0) < n + 1:
        _CACHE.update(n=n + 1, up=_powers(_BASE, n + 1), down=_powers(_BACK, n + 1))
    up, down = _CACHE["up"], _CACHE["down"]
    sums = np.zeros(n + 1, _U)
    np.cumsum(_BYTE[raw] * up[:n], out=sums[1:])
    low = _mixed((sums[GRAM:] - sums[:-GRAM]) * down[: n + 1 - GRAM])
    width, have = length - GRAM + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    start = np.arange(n - length + 1)
    text = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))[: len(start)]
    fits = start + length <= (first + size)[text]
    new = np.ones(len(start), bool)
    new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1]) | ~fits[:-1]
    heads = np.flatnonzero(new & fits)
    if not len(heads):
        return empty, empty, empty, empty.view(_U), empty.view(_U)
    # a run ends before the next head, or where strings no longer fit
    last_fit = (first + size)[text[heads]] - length
    ends = np.minimum(np.append(heads[1:], len(start)) - 1, last_fit)
    count = ends - heads + 1
    cover = _mixed((sums[ends + length] - sums[heads]) * down[heads] + count.astype(_U))
    for i in np.flatnonzero(count + length - 1 > PLAIN).tolist():  # runs overlap by less than length, so that this stays linear
        cover[i] = int.from_bytes(hashlib.blake2b(raw[heads[i] : ends[i] + length].tobytes(), digest_size=8).digest(), "little")
    return text[heads], heads - first[text[heads]], count, low[heads], cover


_CACHE: dict = {}


def two_stage(text: np.ndarray, stop: np.ndarray, depth: int) -> np.ndarray:
    """The suffix array of `text` (bytes), in the order of suffixes' first `depth` bytes; stop[i] is where the part that i lies in ends, and a suffix ends there.

    Only suffixes smaller than their successors are sorted directly. Each other suffix is larger than its successor, so a scan
    from the smallest suffix on meets the successor first, and puts it at the front of its first byte's bucket.
    """
    n = len(text)
    after = np.append(text[1:], 0)
    at_end = np.arange(n) + 1 == stop
    less = (text < after) & ~at_end
    same = (text == after) & ~at_end
    # a run of one byte is as its last byte is
    decided = np.where(same, n, np.arange(n))
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    small = less[decided]
    whole = text.tobytes()
    at = np.flatnonzero(small)
    keys = [whole[i:e] for i, e in zip(at.tolist(), np.minimum(at + depth, stop[at]).tolist(), strict=True)]
    direct = at[sorted(range(len(at)), key=keys.__getitem__)]
    # each bucket of a byte holds first the induced suffixes, then the directly sorted ones; a part's last byte comes before all
    size = np.bincount(text, minlength=256)
    heads = np.cumsum(size) - size
    large = np.bincount(text[~small], minlength=256)
    few = size - large
    placed = np.full(n, -1)
    placed[np.arange(len(direct)) + np.repeat(heads + large - (np.cumsum(few) - few), few)] = direct
    order = placed.tolist()
    fill = heads.tolist()
    for i in np.flatnonzero(at_end).tolist():  # their successor is the empty suffix, smaller than all
        c = whole[i]
        order[fill[c]] = i
        fill[c] += 1
    starts = np.zeros(n, bool)
    starts[np.append(0, stop[:-1][at_end[:-1]])] = True
    before = np.full(n + 1, -1)  # the induced suffix that a suffix is the successor of; none for the last entry, which -1 reads
    before[1:n] = np.where(~small[:-1] & ~starts[1:], np.arange(n - 1), -1)
    before = before.tolist()
    for i in order:  # the list grows ahead of the scan
        j = before[i]
        if j >= 0:
            c = whole[j]
            order[fill[c]] = j
            fill[c] += 1
    return np.array(order, np.int64)


def repeated(contexts: list[bytes], docs: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """Runs (context number, first string, number of strings) of strings that a context of a smaller document has too: neighbours in the suffix array with a common prefix of `length` or more form a group, and its smallest document keeps its strings."""
    text = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    first = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(contexts)), sizes)
    stop = (first + sizes)[of]
    order = two_stage(text, stop, length)
    order = order[order + length <= stop[order]]
    if len(order) < 2:
        return []
    wide = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.zeros(len(text), _U)
    for b in range(8):
        eight |= wide[b : len(text) + b].astype(_U) << _U(8 * b)
    a, b = order[:-1], order[1:]
    equal = np.ones(len(a), bool)
    for at in [*range(0, length - 7, 8), length - 8]:
        equal &= eight[a + at] == eight[b + at]
    heads = np.flatnonzero(np.append(True, ~equal))
    least = np.minimum.reduceat(docs[of[order]], heads)
    group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
    hit = np.sort(order[docs[of[order]] > least[group]])
    if not len(hit):
        return []
    cut = np.flatnonzero(np.append(True, (np.diff(hit) != 1) | (of[hit[1:]] != of[hit[:-1]])))
    count = np.diff(np.append(cut, len(hit)))
    return list(zip(of[hit[cut]].tolist(), (hit[cut] - first[of[hit[cut]]]).tolist(), count.tolist(), strict=True))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("raw"))


def marked_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows (doc, p0, n): n strings of `length` bytes from byte p0 on start in a document of smaller doc_id too.

    1. Each text is cut into runs of strings with one anchor. Of equal runs a task sends the one of its
    smallest document; larger documents' copies are marked at once, so that a passage in a third of all documents sends a row a task.
    2. Rows are dealt by anchor and sorted; a scan with constant memory marks larger documents' equal runs, and asks for the bytes
    of the others where an anchor has several different runs.
    3. Those bytes, with one copy of each different run, are dealt by anchor again and suffix-sorted in blocks.
    4. Strings of hot anchors, whose contexts are too many for one task, are dealt by their own bytes: equal strings
    have equal anchors, so the smallest document of each string is an aggregate.
    """

    def cut(batches):
        for batch in batches:
            found = []
            sizes = np.asarray(pa.compute.binary_length(batch.column(1)))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK)))
                raw = np.frombuffer(b"".join(batch.column(1).slice(at, end - at).to_pylist()), np.uint8)
                size = sizes[at:end].astype(np.int64)
                text, p0, n, f, h = anchors(raw, np.cumsum(size) - size, size, length)
                found.append((ids[at + text].astype(np.int64), p0, n, f.view(np.int64), h.view(np.int64)))
                at = end
            if not found:
                continue
            doc, p0, n, f, h = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((p0, doc, h, f))
            doc, p0, n, f, h = doc[order], p0[order], n[order], f[order], h[order]
            new = np.ones(len(f), bool)
            new[1:] = (f[1:] != f[:-1]) | (h[1:] != h[:-1])
            heads = np.flatnonzero(new)
            least = np.repeat(doc[heads], np.diff(np.append(heads, len(f))))
            n = np.where(doc > least, -n, n)  # a negative number: marked already
            for a in range(0, len(f), 50_000):
                z = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (f[z], h[z], doc[z], p0[z].astype(np.int64), n[z].astype(np.int64))], names=["f", "h", "doc", "p0", "n"])

    runs = _texts(docs).where("doc_id is not null").mapInArrow(cut, "f bigint, h bigint, doc bigint, p0 bigint, n bigint")
    dealt = runs.repartition(F.when(F.col("n") < 0, F.xxhash64("doc", "p0")).otherwise(F.col("f"))).sortWithinPartitions("f", "h", "doc")

    def scan(batches):
        at_f = at_h = at_doc = None  # the open anchor, run and that run's smallest document
        several, waiting = False, []  # whether the anchor has had two different runs; rows of the first one until then
        for batch in batches:
            f, h, doc, p0, n = (batch.column(i).to_numpy() for i in range(5))
            done = n < 0
            out = [(doc[done], p0[done], -n[done], np.zeros(int(done.sum()), np.int64), np.zeros(int(done.sum()), bool))]
            f, h, doc, p0, n = (x[~done] for x in (f, h, doc, p0, n))
            if len(f):
                new_f = np.append(at_f is None or f[0] != at_f, f[1:] != f[:-1])
                new_h = new_f | np.append(at_h is None or h[0] != at_h, h[1:] != h[:-1])
                head = np.maximum.accumulate(np.where(new_h, np.arange(len(f)), -1))
                least = np.where(head >= 0, doc[np.maximum(head, 0)], at_doc if at_doc is not None else 0)
                copy = doc > least
                out.append((doc[copy], p0[copy], n[copy], np.zeros(int(copy.sum()), np.int64), np.zeros(int(copy.sum()), bool)))
                group = np.cumsum(new_f)  # 0: still the open anchor
                kinds = np.bincount(group, new_h & ~new_f, int(group[-1]) + 1)
                many = kinds > 0
                many[0] |= several
                rows = np.flatnonzero(~copy & many[group])
                if many[0] and waiting:
                    out += waiting
                waiting = [] if many[0] or group[-1] > 0 else waiting
                out.append((doc[rows], p0[rows], n[rows], f[rows], np.ones(len(rows), bool)))
                several = bool(many[-1])
                if not several:
                    rest = np.flatnonzero(~copy & (group == group[-1]))
                    waiting.append((doc[rest], p0[rest], n[rest], f[rest], np.ones(len(rest), bool)))
                at_f, at_h, at_doc = f[-1], h[-1], least[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["doc", "p0", "n", "f", "ask"])

    told = stage(dealt.mapInArrow(scan, "doc bigint, p0 bigint, n bigint, f bigint, ask boolean"))
    ask = told.where("ask").select("doc", "p0", "n", "f")
    hot = stage(ask.groupBy("f").agg(F.sum(F.col("n") - 1 + length).alias("bytes")).where(F.col("bytes") > HOT).select("f"))
    some_hot = not hot.isEmpty()
    once = _texts(docs).where("doc_id is not null")

    def fetch(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                doc, raw, runs = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([r["f"] for r in runs], pa.int64()), pa.array([doc] * len(runs), pa.int64()), pa.array([r["p0"] for r in runs], pa.int64()), pa.array([raw[r["p0"] : r["p0"] + r["n"] - 1 + length] for r in runs], pa.binary())], names=["f", "doc", "p0", "bytes"])

    def contexts_of(runs: DataFrame) -> DataFrame:
        asked = runs.groupBy("doc").agg(F.collect_list(F.struct("f", "p0", "n")).alias("runs"))  # a text's length bounds its list
        return once.join(asked, F.col("doc_id") == F.col("doc")).select("doc_id", "raw", "runs").mapInArrow(fetch, "f bigint, doc bigint, p0 bigint, bytes binary")

    contexts = contexts_of(ask.join(hot, "f", "left_anti") if some_hot else ask)
    contexts = contexts.repartition("f").sortWithinPartitions("f")

    def sort(batches):
        held: list[tuple[int, int, int, bytes]] = []
        size = 0

        def flush(rows):
            got = repeated([r[3] for r in rows], np.array([r[1] for r in rows], np.int64), length)
            return pa.RecordBatch.from_arrays([pa.array([rows[c][1] for c, _, _ in got], pa.int64()), pa.array([rows[c][2] + p for c, p, _ in got], pa.int64()), pa.array([n for _, _, n in got], pa.int64())], names=["doc", "p0", "n"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= SORTED and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield flush(held)

    sorted_runs = stage(contexts.mapInArrow(sort, "doc bigint, p0 bigint, n bigint"))
    out = told.where("not ask").select("doc", "p0", "n").unionByName(sorted_runs)
    if not some_hot:
        return out
    each = F.sequence(F.lit(1), F.length("bytes") - length + 1)
    strings = contexts_of(ask.join(hot, "f", "left_semi")).select("doc", "p0", "bytes", F.explode(each).alias("at"))
    strings = stage(strings.select("doc", (F.col("p0") + F.col("at") - 1).alias("p0"), F.substring("bytes", F.col("at"), F.lit(length)).alias("string")))
    least = strings.groupBy("string").agg(F.min("doc").alias("least"), F.max("doc").alias("last")).where("least < last").select("string", "least")
    return out.unionByName(strings.join(least, "string").where("doc > least").select("doc", "p0", F.lit(1).cast("long").alias("n")))


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the remaining bytes).

    A byte goes if a string of `length` bytes over it also starts in a document of smaller doc_id, as the texts are given. Null
    and empty texts have no bytes; texts shorter than `length` lose none; a null doc_id is in no order: it loses and takes nothing;
    rows with one doc_id are taken to be equal and get equal results; other columns are ignored.
    """
    runs = marked_runs(docs, length).groupBy("doc").agg(F.collect_list(F.struct("p0", "n")).alias("runs"))

    def apply(batches):
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                raw, runs = batch.column(1)[i].as_py(), batch.column(2)[i].as_py() or []
                edge = np.zeros(len(raw) + 1, np.int64)
                for r in runs:
                    edge[r["p0"]] += 1
                    edge[r["p0"] + r["n"] - 1 + length] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                rows.append((len(raw), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
            n, removed, spans, sha = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = _texts(docs).join(runs, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "raw", "runs")
    return joined.mapInArrow(apply, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
