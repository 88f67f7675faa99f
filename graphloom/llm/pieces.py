"""SentencePiece encoding by sampled segmentation (forward filtering, backward sampling) and lossless decoding."""

from __future__ import annotations

import math
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Bytes of text that are handled at once, one whole text at least.
CHUNK = 1 << 19
#: Segments of more characters are walked one by one: a step over all segments at once pays only for many of them.
LONG = 256
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A counter's 64 random bits."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Lattices:
    """Piece lattices: forward sums and sampling for all segments of a chunk of texts at once.

    A piece holds its space marks in front only, so no piece crosses the place before a mark that follows another
    character, nor a line break; those places cut a text into segments whose lattices are independent, and sampling
    each segment by itself is sampling the whole text. The edges into a node have cumulative chances in steps of
    2**-BITS, added to the node's number, so that one search over integers serves all nodes.
    """

    BITS = 30
    BASE = _U(0x100000001B3)

    def __init__(self, model: bytes, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.byte = [0] * 256
        self.raw: list[bytes] = []
        ranks = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                self.raw.append(piece.replace(SPACE, " ").encode())
                ranks[piece.replace(SPACE, " ")] = i
        if any(" " in p.lstrip(" ") or "\n" in p for p in ranks):
            raise ValueError("a piece of this model holds a space mark after other characters, or a line break")
        norm = math.log(sum(1 / (i + 1) for i in range(len(ranks))))
        ordered = sorted(ranks.items(), key=lambda x: (-sp.get_score(x[1]), x[1]))
        self.table = {piece: (i, -alpha * (math.log(k + 1) + norm)) for k, (piece, i) in enumerate(ordered)}
        self.low = -alpha * (math.log(len(ranks) + 1) + norm)
        self.longest = max(map(len, self.table))
        self.weight = np.zeros(sp.get_piece_size())
        for i, w in self.table.values():
            self.weight[i] = w
        keys = np.array([self._hash(p) for p in self.table], _U)
        self.slots = np.full(1 << 20, -1, np.int32)  # open addressing by the hash's top bits
        self.slot_keys = np.zeros(1 << 20, _U)
        self.probes = 1
        for key, (i, _) in zip(keys.tolist(), self.table.values(), strict=True):
            at, probes = key >> 44, 1
            while self.slots[at] >= 0:
                at, probes = (at + 1) & 0xFFFFF, probes + 1
            self.slots[at], self.slot_keys[at], self.probes = i, key, max(self.probes, probes)

    def _hash(self, piece: str) -> int:
        h = np.zeros(1, _U)
        for c in piece:
            h = h * self.BASE + _U(ord(c) + 1)
        return int(_mixed(h)[0])

    def _lookup(self, h: np.ndarray) -> np.ndarray:
        """The pieces of hashed strings, -1 for none."""
        h = _mixed(h)
        out = np.full(len(h), -1, np.int32)
        at = (h >> _U(44)).astype(np.int64)
        rest = np.arange(len(h))
        for _ in range(self.probes):
            found = self.slots[at]
            hit = (found >= 0) & (self.slot_keys[at] == h[rest])
            out[rest[hit]] = found[hit]
            on = (found >= 0) & ~hit
            rest, at = rest[on], (at[on] + 1) & 0xFFFFF
            if not len(rest):
                break
        return out

    def build(self, segments: list[str]) -> tuple[np.ndarray, ...]:
        """The lattices of distinct segments: each one's first node and length, and the edges by the node they enter: cumulative chance, node they leave, piece (below -1: a character spelt in bytes, by its code point)."""
        lens = np.array([len(x) for x in segments], np.int64)
        code = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        off = np.cumsum(lens) - lens
        base = off + np.arange(len(lens))  # a segment of n characters has n + 1 nodes
        node = np.arange(len(code)) + np.repeat(np.arange(len(lens)), lens)
        left = np.repeat(off + lens, lens) - np.arange(len(code))
        live, h = np.arange(len(code)), np.zeros(len(code), _U)
        starts, sizes, pieces = [], [], []
        for n in range(1, self.longest + 1):
            keep = left[live] >= n
            live, h = live[keep], h[keep]
            if not len(live):
                break
            h = h * self.BASE + (code[live + n - 1] + 1).astype(_U)
            piece = self._lookup(h)
            if n == 1:
                odd = np.flatnonzero(piece < 0)
                piece = piece.astype(np.int64)
                piece[odd] = -2 - code[odd]
                hit = np.arange(len(piece))
            else:
                hit = np.flatnonzero(piece >= 0)
            starts.append(live[hit])
            sizes.append(np.full(len(hit), n))
            pieces.append(piece[hit].astype(np.int64))
        start, size, piece = np.concatenate(starts), np.concatenate(sizes), np.concatenate(pieces)
        weight = self.weight[np.maximum(piece, 0)]
        odd = np.flatnonzero(piece < 0)
        if len(odd):
            c = -2 - piece[odd]
            weight[odd] = self.low * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))
        leaves = node[start]
        enters = leaves + size
        depth = enters - np.repeat(base, lens)[start]
        depth[np.repeat(lens, lens)[start] > LONG] = 0  # to the front
        order = np.lexsort((size, enters, depth))
        leaves, enters, piece, weight, depth = leaves[order], enters[order], piece[order], weight[order], depth[order]
        forward = np.zeros(len(code) + len(lens))
        chance = np.zeros(len(order))
        alone = int(np.searchsorted(depth, 0, "right"))
        self._walk(leaves[:alone], enters[:alone], weight[:alone], chance)
        cuts = alone + np.flatnonzero(np.diff(depth[alone:], prepend=0))
        for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            value, to = forward[leaves[a:b]] + weight[a:b], enters[a:b]
            heads = np.flatnonzero(np.diff(to, prepend=-1))
            many = np.diff(np.append(heads, b - a))
            top = np.maximum.reduceat(value, heads)
            part = np.exp(value - np.repeat(top, many))
            total = np.zeros(len(heads))
            rank = np.arange(b - a) - np.repeat(heads, many)
            group = np.repeat(np.arange(len(heads)), many)
            for r in range(int(many.max())):  # in each node's own order, so that sums don't depend on the chunk
                at = np.flatnonzero(rank == r)
                total[group[at]] += part[at]
                chance[a + at] = total[group[at]]
            forward[to[heads]] = top + np.log(total)
            chance[a:b] /= total[group]
            chance[a + heads + many - 1] = 1.0
        order = np.argsort(enters, kind="stable")
        cum = (enters[order] << self.BITS) + np.rint(chance[order] * (1 << self.BITS)).astype(np.int64)
        return base, lens, cum, leaves[order], piece[order]

    @staticmethod
    def _walk(leaves: np.ndarray, enters: np.ndarray, weight: np.ndarray, chance: np.ndarray) -> None:
        """Cumulative chances of edges sorted by the node they enter, node by node; a node that none enters has a sum of 0."""
        forward: dict[int, float] = {}
        at, leave, gain = 0, leaves.tolist(), weight.tolist()
        ends = np.append(np.flatnonzero(np.diff(enters)) + 1, len(enters)).tolist() if len(enters) else []
        for end in ends:
            value = [forward.get(leave[k], 0.0) + gain[k] for k in range(at, end)]
            top, total, sums = max(value), 0.0, []
            for v in value:
                total += math.exp(v - top)
                sums.append(total)
            forward[int(enters[at])] = top + math.log(total)
            chance[at:end] = np.array(sums) / total
            chance[end - 1] = 1.0
            at = end

    def _draw(self, key: int, begin: int, state: int, cum: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """The edges of one segment from its last node back, with the random numbers that sample() would use."""
        out, block = [], 1024
        while state > begin:
            u = (_mixed(np.full(block, key, _U) + np.arange(len(out), len(out) + block).astype(_U)) >> _U(64 - self.BITS)).tolist()
            for x in u:
                edge = int(np.searchsorted(cum, (state << self.BITS) + x, "right"))
                out.append(edge)
                state = int(leaves[edge])
                if state <= begin:
                    break
        return np.array(out, np.int64)

    def sample(self, texts: list[str], row_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts together, and where each text's ids begin (one entry more than texts)."""
        known: dict[str, int] = {}
        number = known.setdefault
        which: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                before = len(which)
                which += [number(s, len(known)) for s in _SEGMENT.findall(" " + t)]
                counts[i] = len(which) - before
        n = len(which)
        first = np.cumsum(counts) - counts
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        base, lens, cum, leaves, piece = self.build(list(known))
        seg = np.array(which, np.int64)
        place = np.arange(n) - np.repeat(first, counts)
        keys = _mixed(np.repeat(row_keys, counts) ^ _mixed(place.astype(_U)))
        begin = base[seg]
        state = begin + lens[seg]
        live, taken, steps = np.flatnonzero(lens[seg] <= LONG), [], np.zeros(n, np.int64)
        drawn = {int(k): self._draw(int(keys[k]), int(begin[k]), int(state[k]), cum, leaves) for k in np.flatnonzero(lens[seg] > LONG)}
        for k, edges in drawn.items():
            steps[k] = len(edges)
        while len(live):
            u = (_mixed(keys[live] + _U(len(taken))) >> _U(64 - self.BITS)).astype(np.int64)
            edge = np.searchsorted(cum, (state[live] << self.BITS) + u, "right")
            taken.append((live, edge))
            steps[live] += 1
            state[live] = leaves[edge]
            live = live[state[live] > begin[live]]
        at = np.cumsum(steps) - steps
        ids = np.zeros(int(steps.sum()), np.int64)
        for k, (who, edge) in enumerate(taken):
            ids[at[who] + steps[who] - 1 - k] = piece[edge]
        for k, edges in drawn.items():
            ids[at[k] : at[k] + steps[k]] = piece[edges[::-1]]
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            spelt = [[self.byte[b] for b in chr(-2 - k).encode("utf-8", "surrogatepass")] for k in ids[odd].tolist()]
            width = np.ones(len(ids), np.int64)
            width[odd] = [len(x) for x in spelt]
            ends = np.concatenate(([0], np.cumsum(width)))
            ids = np.repeat(ids, width)
            for k, x in zip(ends[odd].tolist(), spelt, strict=True):
                ids[k : k + len(x)] = x
            steps = ends[at + steps] - ends[at]
        total = np.concatenate(([0], np.cumsum(steps)))
        return ids, total[np.concatenate((first, [n]))]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


#: A run of spaces with what follows it up to the next space, or a line break.
_SEGMENT = re.compile(r" *[^ \n]+| +|\n")
_OPEN: dict[tuple[int, float], Lattices] = {}


def _opened(model: bytes, alpha: float) -> Lattices:
    """The lattices of this worker; they stay for its next tasks."""
    key = (hash(model), alpha)
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Lattices(model, alpha)
    return _OPEN[key]


def row_keys(ids: list[int | None], seed: int) -> np.ndarray:
    """What a row's random numbers start from: its doc_id and the seed alone, so neither partitions nor batches matter. A null doc_id counts as -1."""
    return _mixed(np.array([-1 if i is None else i for i in ids], np.int64).view(_U) ^ _mixed(np.array([seed], np.int64).view(_U)))


def encode(docs: DataFrame, model: str = MODEL, alpha: float = 1.0, seed: int = 17, verify: bool = True) -> DataFrame:
    """One row a document: doc_id, ids (array<int>), n_pieces, lossless.

    ids is drawn from all ways to write the text in pieces, each with a chance in proportion to the product of its
    pieces' weights to the power alpha. The model is a merge list without probabilities; a piece's weight is one over its
    rank. Characters that no piece spells become byte pieces, as does a literal space mark. As the model asks, a space is put
    before the text; decode() takes it off. lossless: whether decoding ids gives the text again (null with verify=False).
    Equal (doc_id, text, seed) give equal ids on any cluster. A null or empty text has no ids and is lossless (as an
    empty text); a null doc_id is kept; repeated rows give equal ids; other columns are ignored. Texts are cut into segments, never
    truncated: long texts and long runs without a space cost time in proportion to their length. No shuffle.
    """
    proto = Path(model).read_bytes()

    def run(batches):
        lattices = _opened(proto, alpha)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK)))
                part = [t or "" for t in texts.slice(at, end - at).to_pylist()]
                pieces, cuts = lattices.sample(part, row_keys(ids.slice(at, end - at).to_pylist(), seed))
                same = None
                if verify:
                    listed, c = pieces.tolist(), cuts.tolist()
                    same = [lattices.decode(listed[c[i] : c[i + 1]]) == t for i, t in enumerate(part)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, end - at), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(pieces, pa.int32())), pa.array(np.diff(cuts), pa.int64()), pa.array(same if verify else [None] * len(part), pa.bool_())], names=["doc_id", "ids", "n_pieces", "lossless"])
                at = end

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id bigint, ids array<int>, n_pieces bigint, lossless boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Rows (doc_id, text) of rows (doc_id, ids): the inverse of encode(). Null or empty ids give an empty text."""
    proto = Path(model).read_bytes()

    def run(batches):
        lattices = _opened(proto, 1.0)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([lattices.decode(i or []) for i in part.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as bigint) doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
