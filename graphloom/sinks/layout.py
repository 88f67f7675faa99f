"""Positions and charts for a few nodes or counts, on the driver."""

from __future__ import annotations

import math
from html import escape

import numpy as np

SCALE = 200.0


def circular(n: int, scale: float = SCALE) -> np.ndarray:
    angle = 2 * math.pi * np.arange(n) / max(n, 1)
    return scale * np.stack([np.cos(angle), np.sin(angle)], 1)


def spring(n: int, edges: list[tuple[int, int]], rounds: int = 50, length: float = 3.0, scale: float = SCALE, seed: int = 42) -> np.ndarray:
    """Positions (n, 2): neighbours attract with the square of their distance, all nodes repel with its inverse, steps cool linearly. For pattern-sized graphs."""
    if n < 2:
        return np.zeros((n, 2))
    p = np.random.default_rng(seed).uniform(-1, 1, (n, 2))
    near = np.zeros((n, n))
    for a, b in edges:
        if a != b:
            near[a, b] = near[b, a] = 1
    k = length / math.sqrt(n)
    for i in range(rounds):
        d = p[:, None] - p[None]
        r = np.maximum(np.linalg.norm(d, axis=2), 0.01)
        push = (d * (k * k / r**2 - near * r / k)[:, :, None]).sum(1)
        size = np.maximum(np.linalg.norm(push, axis=1, keepdims=True), 0.01)
        p = p + push / size * np.minimum(size, 0.1 * (1 - i / rounds) * 2)
    p -= p.mean(0)
    return scale * p / max(np.abs(p).max(), 1e-9)


def counts_chart(rows: list[tuple[int, float, float, float]], title: str) -> str:
    """An SVG of medians by pattern size with their quartile band, on a logarithmic axis. rows: (size, q25, median, q75)."""
    rows = sorted(r for r in rows if r[2] > 0)
    if not rows:
        return f"<svg xmlns='http://www.w3.org/2000/svg' width='480' height='320'><text x='20' y='30'>{escape(title)}: no counts</text></svg>"
    low, high = math.log10(max(min(r[1] for r in rows), 0.5)), math.log10(max(r[3] for r in rows)) + 1e-9
    x = lambda s: 50 + 400 * (s - rows[0][0]) / max(rows[-1][0] - rows[0][0], 1)
    y = lambda v: 280 - 240 * (math.log10(max(v, 0.5)) - low) / max(high - low, 1e-9)
    band = " ".join(f"{x(s):.1f},{y(q):.1f}" for s, q, _, _ in rows) + " " + " ".join(f"{x(s):.1f},{y(q):.1f}" for s, _, _, q in reversed(rows))
    line = " ".join(f"{x(s):.1f},{y(m):.1f}" for s, _, m, _ in rows)
    ticks = "".join(f"<text x='{x(s):.1f}' y='300'>{s}</text>" for s, *_ in rows) + "".join(f"<text x='4' y='{y(10.0**e):.1f}'>1e{e}</text>" for e in range(math.ceil(low), math.floor(high) + 1))
    return f"<svg xmlns='http://www.w3.org/2000/svg' width='480' height='320'><text x='50' y='20'>{escape(title)}</text><polygon points='{band}' fill='#ccd' /><polyline points='{line}' fill='none' stroke='#336' />{ticks}</svg>"
