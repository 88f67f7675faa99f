"""Personal data: strict patterns, and a skip-chain conditional random field that carries their labels to repeated and similar tokens."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import per_text

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
FOUND = "array<struct<kind:string,start:int,end:int,prob:double>>"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"\+?[0-9(][0-9().\x20/-]{5,40}[0-9]")
_AT = re.compile(r"[A-Za-z0-9._%+-]{2,64}\s?(?:@|[\[(]at[\])]|\sat\s)\s?[A-Za-z0-9-]+(?:\s?(?:\.|[\[(]dot[\])]|\sdot\s)\s?[A-Za-z0-9-]+)+", re.I)
_WORD = re.compile(r"[A-Za-z0-9._%+-]{5,64}")


def _emails(text: str) -> list[tuple[int, int]]:
    """Each @ with the longest run of local characters before it and a dotted name behind it; as the plain pattern finds them, without its quadratic time on long runs."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
        free = max(free, m.end() if m else at + 1)
        at = text.find("@", free)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The strict spans (start, end, kind): leftmost, without overlaps within a kind; failing matches are dropped."""
    out = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def shape(token: str) -> str:
    """A token's class: number of digits to 20, and which marks it holds. At most a few hundred classes."""
    n = min(20, len(_DIGIT.findall(token)))
    return f"{n}{'@' if '@' in token else ''}{'+' if token.startswith('+') else ''}{'.' if token.count('.') == 3 else ''}{'a' if any(c.isalpha() for c in token) else ''}"


def keys(token: str, kind: str) -> list[str]:
    """What makes two tokens repeated or similar: equal digits, equal last seven digits, equal letters of an address, equal local part."""
    if kind == "number":
        d = "".join(_DIGIT.findall(token))
        return [f"d{d}", *([f"t{d[-7:]}"] if len(d) >= 9 else [])]
    low = re.sub(r"[\[(]|[\])]", " ", token.lower())
    low = re.sub(r"\s+at\s+|\s*@\s*", "@", low)
    low = re.sub(r"\s+dot\s+|\s*\.\s*", ".", low).strip(" .")
    return [f"m{low}", f"l{low.partition('@')[0]}"]


def nodes(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, int, list[str]]]:
    """The field's nodes in text order: (start, end, label or 0, keys). Strict spans are nodes of their label; number-like and address-like tokens outside of them, and words equal to an address's local part, are nodes that may take one."""
    out, taken = [], np.zeros(len(text) + 1, bool)
    local = set()
    for a, b, k in base:
        taken[a:b] = True
        ks = keys(text[a:b], "mail" if k == "email" else "number")
        local |= {x[1:] for x in ks if x[0] == "l" and len(x) > 5}
        out.append((a, b, LABELS.index(k), ks))
    for pattern, kind in ((_AT, "mail"), (_NUMBER, "number")):
        for m in pattern.finditer(text):
            if not taken[m.start() : m.end()].any() and (kind == "mail" or 7 <= len(_DIGIT.findall(m[0])) <= 19):
                taken[m.start() : m.end()] = True
                out.append((m.start(), m.end(), 0, keys(m[0], kind)))
    if local:
        for m in _WORD.finditer(text):
            word = m[0].rstrip(".")
            if word.lower() in local and not taken[m.start() : m.start() + len(word)].any():
                out.append((m.start(), m.start() + len(word), 0, [f"l{word.lower()}"]))
    return sorted(out)


def belief(field: list[tuple[int, int, int, list[str]]], unary: np.ndarray, skip: np.ndarray, chain: np.ndarray, rounds: int = 12, damp: float = 0.5) -> np.ndarray:
    """Loopy sum-product over the nodes: marginals (nodes, labels). skip ties each node to the last one with an equal key, chain ties neighbours; so edges grow with the nodes, never with their pairs."""
    n, pairs, weights, last = len(field), [], [], {}
    for i, (_, _, _, ks) in enumerate(field):
        for j in {last[k] for k in ks if k in last}:
            pairs.append((j, i))
            weights.append(skip)
        if i and field[i][0] - field[i - 1][1] <= 80:
            pairs.append((i - 1, i))
            weights.append(chain)
        last |= dict.fromkeys(ks, i)
    out = unary.copy()
    if pairs:
        e = np.array(pairs)
        src, dst = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
        w = np.array(weights)
        w = np.concatenate([w, w.transpose(0, 2, 1)])
        half = len(pairs)
        back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
        msg = np.zeros((2 * half, unary.shape[1]))
        for _ in range(rounds):
            total = unary.copy()
            np.add.at(total, dst, msg)
            x = (total[src] - msg[back])[:, :, None] + w
            top = x.max(1)
            new = top + np.log(np.exp(x - top[:, None, :]).sum(1))
            msg = damp * msg + (1 - damp) * (new - new.max(1, keepdims=True))
        out = unary.copy()
        np.add.at(out, dst, msg)
    out = np.exp(out - out.max(1, keepdims=True))
    assert len(out) == n
    return out / out.sum(1, keepdims=True)


class Field:
    """Potentials of the field, from counts over all documents: how often a token of a shape has each label, how often
    neighbours have them, and how often two strict spans with an equal key have equal labels, which gives the tie of
    repeated and similar tokens (PRIOR is what is taken as seen before any). doubt, what a token loses because no strict pattern took it, can't be seen in strict spans and is set."""

    #: Agreeing and disagreeing pairs of similar tokens.
    PRIOR = (150.0, 1.0)

    def __init__(self, shapes: dict[tuple[str, int], int], pairs: dict[tuple[int, int], int], doubt: float = 2.0, tie: float | None = None, agree: int = 0, differ: int = 0):
        k = len(LABELS)
        seen: dict[str, np.ndarray] = {}
        for (s, label), n in shapes.items():
            seen.setdefault(s, np.full(k, 0.5))[label] += n
        self.shapes = {s: np.log(v / v.sum()) for s, v in seen.items()}
        self.default = np.log(np.array([0.96] + [0.01] * (k - 1)))
        together = np.full((k, k), 1.0)
        for (a, b), n in pairs.items():
            together[a, b] += n
        together /= together.sum()
        lift = np.log(together / together.sum(1, keepdims=True) / together.sum(0, keepdims=True))
        self.chain = np.clip(lift, -0.3, 0.3)
        self.tie = float(np.log((agree + self.PRIOR[0]) / (differ + self.PRIOR[1]))) if tie is None else tie
        self.skip = self.tie * np.eye(k)
        self.skip[0, 0] = 0.0  # that two tokens agree on no label is no news
        self.doubt = doubt

    def unary(self, text: str, field: list[tuple[int, int, int, list[str]]]) -> np.ndarray:
        """Strict spans hold their label; others have what their shape says, less `doubt` because the strict pattern left them out."""
        out = np.empty((len(field), len(LABELS)))
        for i, (a, b, label, _) in enumerate(field):
            if label:
                out[i] = -30.0
                out[i, label] = 0.0
            else:
                known = self.shapes.get(shape(text[a:b]), self.default)
                out[i, 0] = 0.0
                out[i, 1:] = np.clip(known[1:] - known[0], -1.5, 0.0) - self.doubt
        return out


def find(text: str | None, field: Field, sure: float = 0.65) -> list[tuple[str, int, int, float]]:
    """All spans of a text as (kind, start, end, probability), by start, then kind as in KINDS. The method's spans are tokens whose marginal for a label is above `sure`: repeats of a strict span pass, repeats of each other alone do not."""
    if not text:
        return []
    base = base_spans(text)
    out = [(k, a, b, 1.0) for a, b, k in base]
    if base:
        around = nodes(text, base)
        if len(around) > len(base):
            p = belief(around, field.unary(text, around), field.skip, field.chain)
            for (a, b, label, _), q in zip(around, p, strict=True):
                if not label and (best := int(q.argmax())) and q[best] > sure:
                    out.append((LABELS[best], a, b, float(q[best])))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _counts(text: str | None) -> list[dict]:
    """Counts of one text as (what, a, b, n): shapes with labels, labels of neighbours, and whether strict spans with an equal key, each masked from the other, agree."""
    c: Counter = Counter()
    if text and (base := base_spans(text)):
        around = nodes(text, base)
        for i, (a, b, label, _) in enumerate(around):
            c["s", shape(text[a:b]), label] += 1
            if i and a - around[i - 1][1] <= 80:
                c["p", str(around[i - 1][2]), label] += 1
        last: dict[str, int] = {}
        for _, _, label, ks in around:
            if label:
                for other in {last[x] for x in ks if x in last}:
                    c["t", "", int(other == label)] += 1
                last |= dict.fromkeys(ks, label)
    return [{"what": w, "a": a, "b": b, "n": n} for (w, a, b), n in c.items()]


def fit_field(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Counts over all documents, pre-aggregated by task; what reaches the driver is bounded by the number of shapes times labels."""
    counts = per_text(docs, _counts, "array<struct<what:string,a:string,b:int,n:long>>", "c", id_col, text_col).select(F.explode("c").alias("c"))
    rows = counts.groupBy("c.what", "c.a", "c.b").agg(F.sum("c.n").alias("n")).collect()
    ties = {r.b: r.n for r in rows if r.what == "t"}
    shapes, pairs = ({(r.a, r.b): r.n for r in rows if r.what == "s"}, {(int(r.a), r.b): r.n for r in rows if r.what == "p"})
    return Field(shapes, pairs, agree=ties.get(1, 0), differ=ties.get(0, 0))


def find_pii(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id and found, an array of (kind, start, end, prob) in code points, end exclusive.

    Strict spans always stay. The field adds tokens tied to them: the same number written otherwise, an address spelt
    with "at" and "dot", the local part alone. A document without a strict span has no evidence and gets an empty
    array, as do null and empty texts. Null doc_ids and repeated rows are kept, other columns ignored. Two passes over
    the texts (counts, then spans), no shuffle of texts.
    """
    field = field or fit_field(docs, id_col, text_col)
    return per_text(docs, lambda t: [{"kind": k, "start": a, "end": b, "prob": p} for k, a, b, p in find(t, field)], FOUND, "found", id_col, text_col)
