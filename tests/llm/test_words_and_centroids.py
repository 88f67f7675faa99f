"""Toxicity, spelling variants and centroids against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import centroids, spelling, toxicity

DOCS = "doc_id long, text string, word string, n long, h string, key long, hits string, toxic int"


def documents(spark, rows):
    """Rows (doc_id, text) with extra columns of clashing names."""
    return spark.createDataFrame([(i, t, "x", 1, None, 7, "y", 1) for i, t in rows], DOCS)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_trie_equals_all_distances():
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abé") for _ in range(n))
    for _ in range(60):
        terms = {(word(r.randint(2, 11)), r.random() < 0.25): 1.0 + r.random() for _ in range(8)}
        trie = toxicity.Trie(terms)
        for _ in range(40):
            t = r.choice(list(terms))[0]
            w = list(t)
            for _ in range(r.randint(0, 3)):
                p = r.randint(0, len(w))
                w[p : p + r.randint(0, 1)] = word(r.randint(0, 1))
            w = "".join(w)
            want = {(t, False, distance(t, w)) for t, stem in terms if not stem and distance(t, w) <= toxicity.errors(t)} | {(t, True, 0) for t, stem in terms if stem and w.startswith(t) and len(w) > len(t)}
            assert {(t, stem, d) for t, stem, d, _ in trie.all_matches(w)} == want
            best = min(((-terms[t, stem] * toxicity.PER_ERROR**d, d, t) for t, stem, d in want), default=None)
            assert trie.match(w) == (best and (best[2], best[1], -best[0]))  # the hint loses none


def test_context_tells_quotation_from_abuse():
    lex = toxicity.Lexicon({("idiot", False): 5.0, ("worthless", False): 5.0})
    plain, _ = lex.hits("you are an idiot! really")
    told, _ = lex.hits('she said the word "idiot" in class')
    assert not plain[0][5] and told[0][5] and plain[0][7] > 0.85 > 0.5 > told[0][7]
    (term, word, d, a, b, *_), = lex.hits("😀 such Wortlhess talk")[0]
    assert (term, word, d, a, b) == ("worthless", "Wortlhess", 2, 7, 16)
    assert lex.hits("idioms and worth")[0] == []
    far = '"' + "a " * 300 + "idiot " + "b " * 300 + '"'
    assert not lex.hits(far)[0][0][5]  # the marks are outside of the window
    assert lex.score(*lex.hits("an idiot")) > lex.score(*lex.hits('the word "idiot" he wrote')) > lex.score([], 0)


def test_toxicity_learns_terms(spark):
    r = random.Random(1)
    vocab = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4))) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        words, bad = [r.choice(vocab) for _ in range(60)], i % 6 == 0
        if bad:
            for _ in range(3):
                words[r.randint(0, 59)] = r.choice(["zwork", "quixnast", "zwrok" if i % 4 == 2 else "zwork", f"vexx{r.choice(vocab)}"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad), None))
    labels += [(None, 1, None), (5000, 1, None), (3, None, 1)]
    docs = documents(spark, [*rows, (None, "zwork zwork zwork"), (7001, None), (7002, ""), (7002, ""), (7003, "zwork " * 40_000)])
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    lex = toxicity.fit_toxicity(docs, lab)
    assert {("zwork", False), ("quixnast", False), ("vexx", True)} <= set(lex.terms)
    got = {x.doc_id: x for x in toxicity.find_terms(docs, lex).collect()}
    assert toxicity.find_terms(docs, lex).count() == 905
    held = [x for x in got.values() if x.held_out and x.doc_id is not None and x.doc_id < 900]
    assert len(held) > 150 and all(zlib.crc32(str(x.doc_id).encode()) % 4 == 2 for x in held)
    assert sum(x.predicted == (x.doc_id % 6 == 0) for x in held) / len(held) > 0.97
    assert got[7001].score == got[7002].score < 0.3 and got[7003].n_hits == 40_000 and got[None].predicted == 1 and not got[None].held_out
    repeated = toxicity.labelled(documents(spark, [(1, "b"), (1, "a"), (1, "b"), (None, "c"), (0, None)]), lab, 10_000, "doc_id", "text")
    assert sorted((x.doc_id, x.toxic, x.text) for x in repeated.collect()) == [(0, 1, ""), (1, 0, "a")]
    empty = toxicity.fit_toxicity(documents(spark, []), lab)
    assert empty.terms == {} and [x.score for x in toxicity.find_terms(documents(spark, [(1, "zwork"), (2, None)]), empty).collect()] == [0.5, 0.5]
    assert toxicity.find_terms(documents(spark, []), lex).count() == 0


def test_copies_of_one_toxic_text_teach_no_terms(spark):
    rows = [(i, f"common words number{i} here today") for i in range(60)] + [(100 + i, "harmless copied sentence about gardens") for i in range(60)]
    lab = spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows], "doc_id long, toxic int")
    assert toxicity.fit_toxicity(documents(spark, rows), lab).terms == {}


def brute_variants(rows):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 6 and k >= 5}
    near = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and distance(v, w) == 1] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.mark.parametrize("shard", [spelling.SHARD, 7])
def test_variants_equal_brute_force(spark, shard):
    """Few letters, so that words meet in both directions; a shard of 7 rows splits hot halves."""
    r = random.Random(8)
    rows = []
    pool = ["".join(r.choice("aabÀé") for _ in range(r.randint(5, 9))) for _ in range(70)]
    for i in range(220):
        ws = [pool[int(len(pool) * r.random() ** 3)] for _ in range(30)]
        ws += ["".join(c.upper() if r.random() < 0.3 else c for c in ws[0])]
        rows.append((i - 5, r.choice([" ", "1", "×-"]).join(ws)))
    rows += [(None, "aaaaaab " * 8), (3, None), (3, ""), (4, "bbbbbbb " * 2000), (4, "bbbbbbb " * 2000), (5, "ž" * 50)]
    rows += [(900 + i, "grandbase " * 80 + "grandbas " * 12 + "gandbas " * 2) for i in range(5)]  # a chain of forms
    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in spelling.variants(documents(spark, rows), shard=shard).collect()}
    want = brute_variants(rows)
    assert got == want and sum(f is not None for f, *_ in want.values()) > 4 and any(f != t for f, t, *_ in want.values() if f)
    assert spelling.variants(documents(spark, [])).count() == 0


def test_automata_number_their_words_and_are_minimal():
    r = random.Random(4)
    for _ in range(50):
        words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 7))) for _ in range(60)})
        graph = spelling.Automaton(words)
        assert [graph.number(w) for w in words] == list(range(len(words))) and graph.number("zz") is None
        states, todo = set(), [0]
        while todo:
            s = todo.pop()
            if s not in states:
                states.add(s)
                todo += [to for to, _ in graph.edges[s].values()]
        rights = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))}
        assert len(states) == len(rights)  # a state for each right language
        for w in words[:10]:
            for exact in (0, len(w) // 2):
                want = {v for v in words if distance(v, w) == 1 and any(v == w[:i] + c + w[j:] for i in range(exact, len(w) + 1) for j in (i, i + 1) for c in ["", *"abc"] if j <= len(w))}
                assert graph.near(w, exact) == {words.index(v): v for v in want}


def test_very_long_words_of_one_letter():
    words = sorted(["a" * 4000, "a" * 4001, "a" * 2000 + "b" + "a" * 1999])
    graph = spelling.Automaton(words)
    assert set(graph.near("a" * 4000, 2000).values()) == {"a" * 4001, "a" * 2000 + "b" + "a" * 1999}


VECTORS = "vec_id long, embedding array<double>, label int, v string, cluster int, distance long"


def brute_clusters(rows, k, rounds, size):
    kept = [(i, [math.floor(64 * x) if abs(x) < 2**50 else int(x) * 64 for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        c = [[sum(v[d] for (_, v), a in zip(kept, at, strict=True) if a == j) // at.count(j) for d in range(size)] if j in at else old for j, old in enumerate(c)]
    out = [(i, near(v)[1], min(near(v)[0], 2**63 - 1)) for i, v in kept]
    of = Counter()
    for _, j, d in out:
        of[j] += d
    return sorted(((i, j, d, min(of[j], 2**63 - 1), min(sum(of.values()), 2**63 - 1), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in out), key=str)


@pytest.mark.parametrize("large", [False, True])
def test_clusters_equal_brute_force(spark, large):
    r = random.Random(3)
    rows = [(i, [r.choice([r.gauss(0, 1), 0.5, -0.0078125]) for _ in range(6)]) for i in range(120)]
    rows += [(0, rows[0][1]), (1, [9.0] * 6), (None, [0.1] * 6), (200, None), (201, []), (202, [1.0] * 5), (203, [None] * 6), (204, [math.nan] + [0.0] * 5), (205, [math.inf] + [0.0] * 5), (1 << 62, [0.25] * 6), (-7, [0.0] * 6)]
    if large:
        rows += [(300 + i, [r.choice([-1, 1]) * 10.0 ** r.choice([0, 7, 20, 300]) for _ in range(6)]) for i in range(12)]
    df = spark.createDataFrame([(i, v, 1, "x", 3, 4) for i, v in rows], VECTORS).repartition(5)
    got = sorted((tuple(x) for x in centroids.cluster(df, k=9, rounds=3, size=6).collect()), key=str)
    assert got == brute_clusters(rows, 9, 3, 6)
    few = df.where("vec_id in (0, 202)")
    assert [tuple(x)[:3] for x in centroids.cluster(few, size=6).collect()] == [(0, 0, 0)] * 2
    assert centroids.cluster(df.where("vec_id = 200"), size=6).count() == 0


@pytest.mark.parametrize("name", ["op2_url_filter", "op10_collisions", "op12_spelling", "op13_centroids"])
def test_equals_sql(spark, name):
    import os

    from graphloom.llm.queries import ORACLE_SQL, QUERIES

    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, sf).select(*columns).collect()
    plain = lambda r: tuple(x if x is None or isinstance(x, str | bool) else int(x) if float(x).is_integer() else round(float(x), 9) for x in r)
    assert sorted(map(plain, got), key=str) == sorted(map(plain, want.fetchall()), key=str)


def test_nearest_takes_the_lowest_of_ties():
    at, d = centroids.nearest(np.array([[0, 0], [2, 0]]), [[1, 0], [-1, 0], [3, 0]])
    assert at.tolist() == [0, 0] and d.tolist() == [1, 1]
