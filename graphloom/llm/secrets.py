"""Secret scans: credentials in texts, with parts of one credential linked across a scope."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import per_text

KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")
BASE = KINDS[:3]
FOUND = "array<struct<kind:string,start:int,end:int,link:int>>"

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_ID = re.compile(r"(?<![A-Za-z0-9])(?:client_?id|key_?id|access_?key|account|user_?name|username|login|user)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._@-]{4,})", re.I | re.A)
_LOOSE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9+.-]{1,15}://[A-Za-z0-9._:@-]+|(?<![A-Za-z0-9.-])[a-z0-9-]+(?:\.[a-z0-9-]+)+:[0-9]{2,5}(?![0-9])", re.A)
_BREAK = re.compile(r"\n[^\S\n]*\n")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The strong spans (start, end, kind): leftmost, without overlaps within a kind; too short matches are dropped."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def _loose(s: str) -> bool:
    """A bare string that may be a secret: three classes of characters and 3.5 bits a character."""
    classes = any(c.islower() for c in s) + any(c.isupper() for c in s) + any(c.isdigit() for c in s)
    return classes == 3 and -sum(n / len(s) * log2(n / len(s)) for n in Counter(s).values()) >= 3.5


def _free(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of spans that overlap none of taken (sorted, merged)."""
    starts = [a for a, _ in taken]
    return [(a, b) for a, b in spans if not ((i := bisect_left(starts, b)) and taken[i - 1][1] > a)]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def link(parts: dict[str, list[tuple[int, int]]], breaks: list[int], reach: int) -> dict[tuple[int, int], int]:
    """Interval join of secrets with identifiers and endpoints: two parts meet if at most `reach` code points and no blank line lie between.

    Every identifier and endpoint meets every secret in its reach: one sweep over sorted starts, in which the open parts
    of a side that a part meets become one open part with the largest end, so that a scope with thousands of parts
    makes no pairs. Parts that meet, directly or over others, are a group. Returns part -> number of its group: the
    start of its first secret; parts that meet nothing are left out.
    """
    rows = sorted((a, b, kind == "secret") for kind, spans in parts.items() for a, b in spans)
    root = list(range(len(rows)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    scope, opened = -1, [[], []]  # of identifiers and endpoints, of secrets: (row, end)
    for i, (a, b, secret) in enumerate(rows):
        if (now := bisect_left(breaks, a)) != scope:
            scope, opened = now, [[], []]
        met = [(j, end) for j, end in opened[not secret] if end + reach >= a]
        for j, _ in met:
            root[top(j)] = top(i)
        opened[not secret] = [(met[0][0], max(end for _, end in met))] if met else []
        opened[secret].append((i, b))
    first: dict[int, int] = {}
    for i, (a, _, secret) in enumerate(rows):
        if secret:
            first.setdefault(top(i), a)
    size = Counter(map(top, range(len(rows))))
    return {(a, b): first[top(i)] for i, (a, b, _) in enumerate(rows) if size[top(i)] > 1}


def find(text: str | None, reach: int = 200) -> list[tuple[str, int, int, int]]:
    """All spans of a text as (kind, start, end, link), sorted by start, then kind as in KINDS; link is -1 without a group."""
    if not text:
        return []
    base = base_spans(text)
    taken = _merged([(a, b) for a, b, _ in base])
    ids = _free([m.span() for m in _ID.finditer(text)], taken) if "=" in text or ":" in text else []
    loose = _free([m.span() for m in _LOOSE.finditer(text) if _loose(m[0])], taken)
    ends = _free([m.span() for m in _ENDPOINT.finditer(text)], taken) if ":" in text else []
    strong = [(a, b) for a, b, k in base if k == "assign" or k == "hex" and not text[a:b].isdigit()]
    keys = [(a, b) for a, b, k in base if k == "access"]
    groups: dict[tuple[int, int], int] = {}
    if (strong or loose) and (keys or ids or ends):
        breaks = [m.start() for m in _BREAK.finditer(text)]
        groups = link({"id": keys + ids, "secret": strong + loose, "endpoint": ends}, breaks, reach)
    out = [(k, a, b, groups.get((a, b), -1)) for a, b, k in base]
    for kind, weak in (("id", ids), ("secret", loose), ("endpoint", ends)):
        out += [(kind, a, b, groups[a, b]) for a, b in weak if (a, b) in groups]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """One row a document: doc_id and found, an array of (kind, start, end, link) in code points, end exclusive.

    Strong kinds (assign, access, hex) are always reported. Weak identifiers (id), bare strings (secret) and endpoints
    are reported only where complementary parts meet: a secret and an identifier or endpoint within `reach` code points
    of each other with no blank line between; link tells parts of one credential.
    A null or empty text gives an empty array, a null doc_id is kept, repeated rows give repeated rows, other columns
    are ignored. No shuffle: each text is handled where it is read.
    """

    return per_text(docs, lambda t: [{"kind": k, "start": a, "end": b, "link": g} for k, a, b, g in find(t, reach)], FOUND, "found", id_col, text_col)


def redact_secrets(text: str, found: list) -> str:
    """The text with each found span, overlaps merged, replaced by [SECRET]."""
    out, at = [], 0
    for a, b in _merged([(x["start"], x["end"]) for x in found]):
        out += [text[at:a], "[SECRET]"]
        at = b
    return "".join([*out, text[at:]])



def redact(docs: DataFrame, text_col: str = "text", reach: int = 200) -> DataFrame:
    """docs with each found span of text_col replaced by [SECRET]; all rows and columns stay, null texts stay null."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [t and redact_secrets(t, [{"start": a, "end": b} for _, a, b, _ in find(t, reach)]) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(texts, part.schema.field(at).type) if i == at else c for i, c in enumerate(part.columns)], schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
