"""Toxicity: Levenshtein automata intersected with a trie of learned terms, and context windows that tell quotation from abuse."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import drop_stage, stage

WORD = re.compile(r"[^\W_]+")
#: At most so many labelled rows are fitted, those of least hashed doc_id.
FIT_ROWS = 20_000
#: A stem is a learned beginning of words, of so many code points.
STEM = range(4, 13)
#: Code points around a hit that its context is read from.
WINDOW = 160
#: Least log-odds of a term's rate in toxic against other texts.
LEAST_ODDS = 1.5
#: A word's weight falls to this share with each error.
PER_ERROR = 0.6
THRESHOLD = 0.3
CACHE = 1 << 19

QUOTES = re.compile(r"\"[^\"\n]*\"|“[^“”\n]*”|„[^„“”\n]*[“”]|«[^«»\n]*»|`[^`\n]*`")
#: Words of saying and naming, and of address, in English, French, German and Spanish.
TELLING = frozenset("said says wrote called quote quoted word term dit écrit mot appelé citation sagte schrieb wort genannt zitat dijo escribió palabra llamó cita".split())
ADDRESS = frozenset("you your you're tu toi vous ton votre du dich dein ihr euer tú ti usted eres tus".split())
#: What adds up to a hit's context: within quotation marks, told by someone, an address, an exclamation, another hit; where none is there it is at BASE. Log-odds of abuse.
BASE, QUOTED, TOLD, ADDRESSED, SHOUTED, TOGETHER = 1.5, -3.0, -0.7, 0.7, 0.3, 0.5


def errors(term: str) -> int:
    """How many errors a term may be written with."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Trie:
    """Terms, whole words or stems, that words are matched with.

    match() runs the Levenshtein automaton of a word along the trie: bit i of state d says that i code points of the word can
    be read with d errors. Branches where no bit is left are never entered. Stems match exactly, as beginnings of longer words.
    """

    def __init__(self, terms: dict[tuple[str, bool], float]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[str, bool, float]]] = [[]]
        for (term, stem), weight in sorted(terms.items()):
            at = 0
            for ch in term:
                if ch not in self.next[at]:
                    self.next[at][ch] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                at = self.next[at][ch]
            self.ends[at].append((term, stem, weight))
        self.most = [0] * len(self.next)  # errors that any term below may have
        for at in range(len(self.next) - 1, -1, -1):
            self.most[at] = max([0, *(errors(t) for t, stem, _ in self.ends[at] if not stem), *(self.most[k] for k in self.next[at].values())])
        parts = set()
        for term, stem in terms:
            k = 0 if stem else errors(term)
            cut = [len(term) * i // (k + 1) for i in range(k + 2)]
            for i in range(k + 1):
                part = re.escape(term[cut[i] : cut[i + 1]])
                parts.add("^" + part if i == 0 else part + "$" if i == k else part)
        # of a term cut into one part more than it may have errors, one part is left as it was, the first and last at their ends
        self.hint = re.compile("|".join(sorted(parts)) if parts else r"(?!)")

    def all_matches(self, word: str) -> list[tuple[str, bool, int, float]]:
        """(term, stem, distance, weight) of each term that the word may be."""
        n, out = len(word), []
        where: dict[str, int] = {}
        for i, ch in enumerate(word):
            where[ch] = where.get(ch, 0) | 1 << i
        full = (2 << n) - 1
        start = [1]
        for _ in range(self.most[0]):
            start.append(start[-1] | (start[-1] << 1) & full)
        stack = [(0, start, 0)]
        while stack:
            at, state, depth = stack.pop()
            for term, stem, weight in self.ends[at]:
                if stem:
                    if n > depth and state[0] >> depth & 1:
                        out.append((term, True, 0, weight))
                else:
                    d = next((d for d in range(errors(term) + 1) if state[d] >> n & 1), None)
                    if d is not None:
                        out.append((term, False, d, weight))
            for ch, to in self.next[at].items():
                m = where.get(ch, 0)
                new = [(state[0] & m) << 1]
                for d in range(1, self.most[to] + 1):
                    new.append(((state[d] & m) << 1 | state[d - 1] | state[d - 1] << 1 | new[-1] << 1) & full)
                if any(new):
                    stack.append((to, new, depth + 1))
        return out

    def match(self, word: str) -> tuple[str, int, float] | None:
        """(term, distance, weight) of the term of largest weight, which falls with each error; of equal ones the nearest, then the first."""
        if not self.hint.search(word):
            return None
        found = [(-w * PER_ERROR**d, d, t) for t, _, d, w in self.all_matches(word)]
        if not found:
            return None
        w, d, t = min(found)
        return t, d, -w


@dataclass
class Lexicon:
    """Learned terms, words that only look like misspelled ones, and the weights of a document's sums."""

    terms: dict[tuple[str, bool], float]
    innocent: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.array([-3.0, 1.5, 0.0, 0.0]))

    def __post_init__(self):
        self.trie, self.seen = Trie(self.terms), {}

    def __getstate__(self):
        return self.terms, self.innocent, self.weights

    def __setstate__(self, state):
        self.terms, self.innocent, self.weights = state
        self.__post_init__()

    def look(self, word: str) -> tuple[str, int, float] | None:
        """The match of a lower-cased word, remembered for a bounded number of words."""
        if word not in self.seen:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            hit = self.trie.match(word)
            self.seen[word] = None if hit and hit[1] and word in self.innocent else hit
        return self.seen[word]

    def hits(self, text: str) -> tuple[list[tuple], int]:
        """(term, word, distance, start, end, quoted, weight, context) of each hit in code points, and how many words there are."""
        found = WORD.findall(text)
        if not any(self.look(w.lower()) for w in set(found)):
            return [], len(found)
        at = [(m.start(), m.end(), hit) for m in WORD.finditer(text) if (hit := self.look(m[0].lower()))]
        quoted, out, q = [m.span() for m in QUOTES.finditer(text)], [], 0
        for k, (a, b, (term, d, weight)) in enumerate(at):
            while q < len(quoted) and quoted[q][1] <= a:
                q += 1
            inside = q < len(quoted) and quoted[q][0] < a and b < quoted[q][1] and a - quoted[q][0] <= WINDOW and quoted[q][1] - b <= WINDOW
            before, after = text[max(0, a - WINDOW) : a], text[b : b + WINDOW]
            near = {w.lower() for w in WORD.findall(before)[-8:] + WORD.findall(after)[:8]}
            odds = BASE + QUOTED * inside + TOLD * bool(near & TELLING) + ADDRESSED * bool(near & ADDRESS) + SHOUTED * after.lstrip("#$%&*").startswith("!")
            odds += TOGETHER * ((k > 0 and a - at[k - 1][1] <= WINDOW) or (k + 1 < len(at) and at[k + 1][0] - b <= WINDOW))
            out.append((term, text[a:b], d, a, b, inside, weight, 1 / (1 + math.exp(-odds))))
        return out, len(found)

    def score(self, hits: list[tuple], n_words: int) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(sums(hits, n_words) @ self.weights)))))


def sums(hits: list[tuple], n_words: int) -> np.ndarray:
    """A document's inputs: one, its hits' weights by context added up, their density, its length."""
    total = math.fsum(w * c for *_, w, c in hits)
    return np.array([1.0, math.log1p(total), 10 * total / (n_words + 20), math.log1p(n_words) / 5 if hits else 0.0])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of least penalised cross-entropy, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = ridge * np.r_[1e-3, np.ones(len(w) - 1)]
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (p - y) + pull * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def labelled(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, toxic, text) of at most `rows` labelled documents whose crc32(doc_id) mod 4 is not 2, those of least hashed doc_id. Labels that are null or name no document are ignored; a document labelled twice has its larger label; of rows that share a doc_id the least text is taken, so that there are no more rows than labels."""
    marked = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    met = texts.join(F.broadcast(marked), "doc_id")  # `rows` labels at most
    return met.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def sketch(words) -> int:
    """Two least hashes of a text's longer words: equal for most near copies, so that a text that is copied often counts once in what is learned."""
    least = sorted({zlib.crc32(w.encode()) for w in words if len(w) > 3})[:2]
    return least[0] << 31 ^ least[-1] if least else 0


def term_counts(sample: DataFrame) -> DataFrame:
    """(term, stem, t0, t1, d0, d1): occurrences and documents by label, of words and of beginnings of words; the empty term has all words and documents."""

    def run(batches):
        for batch in batches:
            total: dict[tuple[str, bool], list[int]] = {}
            for toxic, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                by_word = Counter(w.lower() for w in WORD.findall(text))
                mine: Counter = Counter()
                for w, k in by_word.items():
                    mine[w, False] += k
                    for n in STEM:
                        if n >= len(w):
                            break
                        mine[w[:n], True] += k
                mine["", False] = sum(by_word.values())
                for key, k in mine.items():
                    of = total.setdefault(key, [0, 0, 0, 0])
                    of[toxic] += k
                    of[2 + toxic] += 1
            columns = list(zip(*total.values(), strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in total], pa.string()), pa.array([s for _, s in total], pa.bool_()), *(pa.array(c, pa.int64()) for c in columns)], names=["term", "stem", "t0", "t1", "d0", "d1"])

    rows = sample.mapInArrow(run, "term string, stem boolean, t0 bigint, t1 bigint, d0 bigint, d1 bigint")
    return rows.groupBy("term", "stem").agg(*(F.sum(c).alias(c) for c in ("t0", "t1", "d0", "d1")))


def choose(rows: list, all_: tuple[int, int, int, int]) -> dict[tuple[str, bool], float]:
    """Terms and their weights of rows (term, stem, t0, t1, d0, d1, evidence). A stem that one word makes up for half or more gives way to the word; of nested stems the one of most evidence is taken, and stands for the words that it begins."""
    n0, n1 = all_[0] + 1, all_[1] + 1
    weight = {(r.term, r.stem): math.log((r.t1 + 0.1) / n1) - math.log((r.t0 + 0.1 + r.t1 * 0.02) / n0) for r in rows}
    by_word: dict[str, int] = {}
    for r in rows:
        if not r.stem:
            for n in STEM:
                by_word[r.term[:n]] = max(by_word.get(r.term[:n], 0), r.t1)
    out: dict[tuple[str, bool], float] = {}
    for r in sorted(rows, key=lambda r: (-r.evidence, not r.stem, len(r.term), r.term)):
        key = (r.term, r.stem)
        if weight[key] < LEAST_ODDS or (r.stem and 2 * by_word.get(r.term, 0) >= r.t1):
            continue
        if any(stem and (r.term.startswith(t) or (r.stem and t.startswith(r.term))) for t, stem in out):
            continue
        if r.stem:
            out = {(t, s): w for (t, s), w in out.items() if s or not t.startswith(r.term)}
        out[key] = weight[key]
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """Terms, innocent look-alikes and weights from labelled(docs, labels).

    A term is a word or a beginning of words that is in many more toxic texts than chance explains (the exponent of the
    binomial tail's bound, above the logarithm of how many terms were tried), at a rate of LEAST_ODDS or more. Words of
    clean texts that a term matches with an error are innocent, unless toxic ones have them more often. No labels of
    one kind: no terms, all scores alike.
    """
    sample = stage(labelled(docs, labels, rows, id_col, text_col))
    once = sample.mapInArrow(_sketches, "doc_id bigint, toxic int, text string, sketch bigint").groupBy("sketch", "toxic").agg(F.min_by("text", F.struct("doc_id", "text")).alias("text")).select(F.lit(None).cast("bigint").alias("doc_id"), "toxic", "text")
    counts = stage(term_counts(once))
    all_ = counts.where("term = ''").collect()
    found: dict[tuple[str, bool], float] = {}
    innocent: frozenset[str] = frozenset()
    if all_ and all_[0].d0 and all_[0].d1:
        a = all_[0]
        base = a.d1 / (a.d0 + a.d1)
        tried = counts.count()
        n, share = F.col("d0") + F.col("d1"), F.col("d1") / (F.col("d0") + F.col("d1"))
        clean = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
        evidence = n * (share * F.log(share / base) + clean)
        strong = counts.where((F.col("term") != "") & (F.col("d1") >= 3)).where(share > base).withColumn("evidence", evidence).where(F.col("evidence") > math.log(tried + 1) + 3)
        found = choose(strong.collect(), (a.t0, a.t1, a.d0, a.d1))  # a part of the sample's words
        trie = Trie(found)

        def alike(batches):
            for batch in batches:
                keep = [bool(hit := trie.match(w)) and hit[1] > 0 for w in batch.column(0).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        less = counts.where("not stem and term <> '' and d0 > 0").where(share <= max(0.5, base)).select("term")
        innocent = frozenset(r.term for r in less.mapInArrow(alike, "term string").collect())  # words of the sample
    drop_stage(counts)
    out = Lexicon(found, innocent)

    def inputs(batches):
        for batch in batches:
            x = np.array([sums(*out.hits(t)) for t in batch.column(2).to_pylist()]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x[:, i]) for i in range(4))], names=["doc_id", "toxic", "x0", "x1", "x2", "x3"])

    got = sample.mapInArrow(inputs, "doc_id bigint, toxic int, x0 double, x1 double, x2 double, x3 double").toPandas()
    got = got.sort_values(list(got.columns), ignore_index=True)
    y = got["toxic"].to_numpy(np.float64)
    if len(y) and y.min() != y.max():
        out.weights = logistic(got[["x0", "x1", "x2", "x3"]].to_numpy(np.float64), y)
    else:
        p = (y.sum() + 1) / (len(y) + 2)
        out.weights = np.array([math.log(p / (1 - p)), 0.0, 0.0, 0.0])
    drop_stage(sample)
    return out


def _sketches(batches):
    for batch in batches:
        yield batch.append_column("sketch", pa.array([sketch(WORD.findall(t.lower())) for t in batch.column(2).to_pylist()], pa.int64()))


FOUND = "array<struct<term:string,word:string,distance:int,start:int,end:int,quoted:boolean,weight:double,context:double>>"


def find_terms(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, held_out, score (0 to 1), predicted, n_hits, n_quoted, hits (term, word as written, distance, start, end in code points, quoted, weight, context).

    Whole texts are scored, each by itself, where they are read. Null and empty texts have no hits and share one score; a null
    doc_id is kept and not held out; repeated rows repeat; other columns are ignored; no rows, no rows.
    """
    kind = pa.list_(pa.struct([("term", pa.string()), ("word", pa.string()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("quoted", pa.bool_()), ("weight", pa.float64()), ("context", pa.float64())]))
    names = [f.name for f in kind.value_type]

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            found = [lexicon.hits(t or "") for t in batch.column(1).to_pylist()]
            score = np.array([lexicon.score(h, n) for h, n in found], dtype=np.float64)
            columns = [ids, pa.array([held_out(i) for i in ids.to_pylist()], pa.bool_()), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array([len(h) for h, _ in found], pa.int64()), pa.array([sum(x[5] for x in h) for h, _ in found], pa.int64())]
            hits = pa.array([[dict(zip(names, x, strict=True)) for x in h] for h, _ in found], type=kind)
            yield pa.RecordBatch.from_arrays([*columns, hits], names=["doc_id", "held_out", "score", "predicted", "n_hits", "n_quoted", "hits"])

    texts = docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text")
    return texts.mapInArrow(run, f"doc_id bigint, held_out boolean, score double, predicted int, n_hits bigint, n_quoted bigint, hits {FOUND}")
