"""Training of the order encoder on a bounded set of labelled pairs, its classifier head and the projection of text features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from graphloom.models.encoder import EncoderSpec, shares

#: At most so many pairs are fitted, those of least pair_id.
PAIRS = 2_000
MARGIN = 0.1
TRAINED = ("sage", "graph", "gin")


def _stacked(graphs: list[tuple[list, list, int]], inputs: int) -> tuple[np.ndarray, ...]:
    """Many graphs (labels, edges, anchor) as one, with the inputs that embed() gives: anchor's flag and label bucket, both directions of the edges, graph of each vertex."""
    x, src, dst, of, at = [], [], [], [], 0
    for g, (labels, edges, anchor) in enumerate(graphs):
        f = np.zeros((len(labels), inputs))
        f[np.arange(len(labels)), 1 + np.asarray(labels, int) % (inputs - 1)] = 1
        f[anchor, 0] = 1
        e = np.asarray(edges, int).reshape(-1, 2) + at
        x.append(f)
        src.append(np.concatenate([e[:, 0], e[:, 1]]))
        dst.append(np.concatenate([e[:, 1], e[:, 0]]))
        of.append(np.full(len(labels), g))
        at += len(labels)
    return np.concatenate(x), np.concatenate(src), np.concatenate(dst), np.concatenate(of)


def _pass(spec: EncoderSpec, w: dict, x, src, dst, of, n) -> tuple[np.ndarray, dict]:
    h = np.maximum(x @ w["pre"], 0)
    c = shares(spec.conv, spec.agg, src, dst, len(x))
    past, ins, told = [h], [], []
    for k in range(spec.layers):
        gate = 1 / (1 + np.exp(-w[f"gate{k}"])) if spec.skip == "learnable" else np.ones(k + 1) if spec.skip == "all" else np.eye(k + 1)[k]
        h = sum(g * p for g, p in zip(gate, past, strict=True))
        t = np.zeros_like(h)
        np.add.at(t, dst, h[src] * c[:, None])
        new = (h + t) @ w[f"nbr{k}"] if spec.conv == "gin" else h @ w[f"self{k}"] + t @ w[f"nbr{k}"]
        ins.append((gate, h))
        told.append(t)
        past.append(np.maximum(new, 0))
    pooled = np.zeros((n, spec.hidden * (spec.layers + 1)))
    np.add.at(pooled, of, np.concatenate(past, 1))
    mid = np.maximum(pooled @ w["post1"], 0)
    return mid @ w["post2"], {"past": past, "ins": ins, "told": told, "pooled": pooled, "mid": mid}


def _gradient(spec: EncoderSpec, w: dict, x, src, dst, of, c: dict, out: np.ndarray) -> dict:
    g, share = {"post2": c["mid"].T @ out}, shares(spec.conv, spec.agg, src, dst, len(x))
    mid = (out @ w["post2"].T) * (c["mid"] > 0)
    g["post1"] = c["pooled"].T @ mid
    flow = np.split((mid @ w["post1"].T)[of], spec.layers + 1, axis=1)
    flow = [f.copy() for f in flow]
    for k in reversed(range(spec.layers)):
        (gate, h), t = c["ins"][k], c["told"][k]
        d = flow[k + 1] * (c["past"][k + 1] > 0)
        if spec.conv == "gin":
            g[f"nbr{k}"] = (h + t).T @ d
            own = back = d @ w[f"nbr{k}"].T
        else:
            g[f"self{k}"], g[f"nbr{k}"] = h.T @ d, t.T @ d
            own, back = d @ w[f"self{k}"].T, d @ w[f"nbr{k}"].T
        own = own.copy()
        np.add.at(own, src, back[dst] * share[:, None])
        for j, a in enumerate(gate):
            flow[j] += a * own
        if spec.skip == "learnable":
            g[f"gate{k}"] = np.array([a * (1 - a) * (own * p).sum() for a, p in zip(gate, c["past"], strict=False)])
    g["pre"] = x.T @ (flow[0] * (c["past"][0] > 0))
    return g


def pair_rows(pairs: DataFrame, most: int = PAIRS) -> list[tuple[int, tuple, tuple]]:
    """At most `most` pairs on the driver: (label, a, b), each graph as (labels, edges, anchor) with places from 0 on."""
    out = []
    for r in pairs.orderBy("pair_id").limit(most).collect():
        graphs = []
        for labels, edges, anchor in ((r.a_labels, r.a, r.a_anchor), (r.b_labels, r.b, r.b_anchor)):
            ids = sorted(labels)
            at = {v: i for i, v in enumerate(ids)}
            graphs.append(([labels[v] for v in ids], [(at[e["src"]], at[e["dst"]]) for e in edges], at[anchor]))
        out.append((r.label, graphs[0], graphs[1]))
    return out


def violation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (np.maximum(b - a, 0) ** 2).sum(1)


def train(rows: list[tuple[int, tuple, tuple]], spec: EncoderSpec, epochs: int = 30, batch: int = 32, rate: float = 3e-3, schedule: str = "cos", clip: float = 1.0, margin: float = MARGIN, seed: int = 1) -> list[float]:
    """Adam on the order loss, in place on spec.weights: what positives violate, and what negatives lack to the margin; gradients are clipped to a norm. Returns the loss of each epoch. Conv sage, graph or gin, by sum or mean; schedule none, step (halved each third) or cos."""
    if spec.conv not in TRAINED or spec.agg == "max":
        raise ValueError(f"trained here are {', '.join(TRAINED)} by sum or mean")
    w = {k: v.astype(np.float64) for k, v in spec.weights.items() if not k.startswith(("bases", "coef"))}
    m, s, t = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    rng, losses = np.random.default_rng(seed), []
    for epoch in range(epochs):
        step = rate * {"none": 1.0, "step": 0.5 ** (3 * epoch // epochs), "cos": (1 + np.cos(np.pi * epoch / epochs)) / 2 + 1e-3}[schedule]
        total = 0.0
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = [rows[i] for i in order[at : at + batch]]
            n, y = len(part), np.array([p[0] for p in part])
            data = _stacked([p[1] for p in part] + [p[2] for p in part], spec.inputs)
            out, cache = _pass(spec, w, *data, 2 * n)
            less = np.maximum(out[n:] - out[:n], 0)
            v = (less**2).sum(1)
            pull = np.where(y == 1, 1.0, np.where(v < margin, -1.0, 0.0))
            total += float(np.where(y == 1, v, np.maximum(margin - v, 0)).sum())
            d = 2 * less * pull[:, None] / n
            g = _gradient(spec, w, *data, cache, np.concatenate([-d, d]))
            norm = np.sqrt(sum((x**2).sum() for x in g.values()))
            t += 1
            for k, x in g.items():
                x = x * min(1.0, clip / (norm + 1e-12))
                m[k] = 0.9 * m[k] + 0.1 * x
                s[k] = 0.999 * s[k] + 0.001 * x * x
                w[k] -= step * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        losses.append(total / max(len(rows), 1))
    spec.weights |= {k: v.astype(np.float32) for k, v in w.items()}
    return losses


def scores(rows: list[tuple[int, tuple, tuple]], spec: EncoderSpec) -> np.ndarray:
    """The violation of each pair."""
    if not rows:
        return np.zeros(0)
    w = {k: v.astype(np.float64) for k, v in spec.weights.items()}
    out, _ = _pass(spec, w, *_stacked([r[1] for r in rows] + [r[2] for r in rows], spec.inputs), 2 * len(rows))
    return violation(out[: len(rows)], out[len(rows) :])


def grid(convs=("gin", "sage"), skips=("all", "last"), layers=(4, 8, 12)) -> list[dict]:
    """All settings of a search over encoders, in order."""
    return [{"conv": c, "skip": s, "layers": n} for c in convs for s in skips for n in layers]


def search_grid(train_rows: list, held_rows: list, settings: list[dict], hidden: int = 16, epochs: int = 5) -> list[tuple[float, dict]]:
    """Held-out area under the curve of each setting, best first."""
    out = []
    for x in settings:
        spec = EncoderSpec(hidden=hidden, **x)
        train(train_rows, spec, epochs)
        out.append((area(-scores(held_rows, spec), np.array([r[0] for r in held_rows])), x))
    return sorted(out, key=lambda r: -r[0])


def area(score: np.ndarray, label: np.ndarray) -> float:
    """The area under the curve: the share of pairs of a positive and a negative in order, ties half."""
    p, q = score[label == 1], score[label == 0]
    return float(((p[:, None] > q).mean() + (p[:, None] == q).mean() / 2)) if len(p) and len(q) else 0.5


@dataclass
class Head:
    """A two-layer classifier of two joined vectors: logarithms of the chances of both classes."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, hidden: int = 256, epochs: int = 60, seed: int = 3) -> Head:
        """Adam on the negative log-likelihood of rows x and classes y."""
        rng = np.random.default_rng(seed)
        p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, 2)), np.zeros(2)]
        m, s, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), 64):
                i = order[at : at + 64]
                h = np.maximum(x[i] @ p[0] + p[1], 0)
                d = np.exp(Head(*p).log_chances(x[i]))
                d[np.arange(len(i)), y[i].astype(int)] -= 1
                d /= len(i)
                back = (d @ p[2].T) * (h > 0)
                t += 1
                for k, g in enumerate((x[i].T @ back, back.sum(0), h.T @ d, d.sum(0))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        return Head(*p)

    def log_chances(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


@dataclass
class Projection:
    """Text vectors to features: linear, rectified, linear, normed over the row."""

    w1: np.ndarray
    w2: np.ndarray

    @staticmethod
    def random(inputs: int = 384, hidden: int = 256, outputs: int = 64, seed: int = 5) -> Projection:
        rng = np.random.default_rng(seed)
        return Projection(rng.normal(0, inputs**-0.5, (inputs, hidden)), rng.normal(0, hidden**-0.5, (hidden, outputs)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1, 0) @ self.w2
        z = z - z.mean(-1, keepdims=True)
        return z / np.sqrt((z * z).mean(-1, keepdims=True) + 1e-5)

    def frame(self, vectors: DataFrame) -> DataFrame:
        """(label, features) of (label, vec), in Arrow batches."""

        def run(batches):
            for pdf in batches:
                if len(pdf):
                    yield pdf.assign(features=self(np.stack(pdf["vec"])).tolist()).drop(columns="vec")

        return vectors.select("label", "vec").mapInPandas(run, "label string, features array<double>")
