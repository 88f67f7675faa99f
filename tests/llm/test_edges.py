"""Edge cases and brute force for what the other tests leave out: links of urls, runs with equal plain hashes, empty tables, long texts, loops of the field, stages' rows."""

import random
import re
from itertools import product
from urllib.parse import urljoin

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import collisions, common, mixing, pieces, pii, quality, secrets, suffix, url_filter

from test_operators import ODD, brute_classes, brute_repeats, documents

SF = "/root/testdata/sf0.001"


def plain(url):
    """The form of a url in which equal pages meet, told by regular expressions."""
    if not url or "://" not in url:
        return None
    host, path, query = re.match(r"([^/?#]*)([^?#]*)(?:\?([^#]*))?", url.split("://", 1)[1]).groups()
    if not host:
        return None
    kept = "&".join(sorted(x for x in (query or "").split("&") if x and not re.match(r"(utm_[a-z]*|gclid|fbclid)=", x)))
    return re.sub(r"^www\.", "", host.lower()) + path.rstrip("/") + (f"?{kept}" if kept else "")


def brute_verdicts(rows, hops):
    """(verdict, component) of each row (page_id, url, links), by union of urls' forms."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in [(plain(a), plain(b)) for a, b in hops]:
        if a and b:
            root[find(a)] = find(b)
    for i, url, links in rows:
        for named in [url, *links]:
            if (form := plain(urljoin(url, named))) is not None:
                root[find(i)] = find(form)
    rule = {}
    for i, url, _ in rows:
        rest = url.split("://", 1)[1]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        fits = [(len(h + p), v) for v, h, p in url_filter.RULES if f".{host.lower()}".endswith(f".{h}") and path.startswith(p)]
        rule[i] = max(fits)[1] if fits else None
    out = {}
    for i, _, _ in rows:
        group = [j for j, _, _ in rows if find(j) == find(i)]
        votes = {rule[j] for j in group} - {None}
        out[i] = (rule[i] or ("block" if votes == {"block"} else "allow"), min(group) if len(group) > 1 else None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_links_of_urls_equal_brute_force(spark, seed):
    r = random.Random(seed)
    hosts = ["a.net", "www.a.net", "B.net", "c.net", "x.com", "www.d.org"]
    url = lambda: f"{r.choice(['http', 'https'])}://{r.choice(hosts)}{r.choice(['', '/', '/de/', '/fr/1', '/p', '/q', '/r/'])}{r.randint(0, 30)}{r.choice(['', '/', '?utm_source=z', '?k=1&b=2', '?b=2&k=1', '#top'])}"
    rows, html = [], []
    for i in range(150):
        links, text = [], "<p>link</p>"
        for _ in range(r.choice([0, 0, 1, 2])):
            to = r.choice([url(), f"/p{r.randint(0, 30)}"])
            canonical = r.random() < 0.5
            text += f"<link rel='canonical' href='{to}'>" if canonical else f'<META http-equiv=refresh content="3; URL={to}">'
            links.append(to)
        rows.append((i, url(), links))
        html.append(text)
    hops = [(url(), url()) for _ in range(15)]
    pages = spark.createDataFrame([(i, u, h, "x", 3) for (i, u, _), h in zip(rows, html, strict=True)], "page_id long, url string, html string, form string, node int")
    got = url_filter.judge_urls(pages, redirects=spark.createDataFrame(hops, "from_url string, to_url string")).collect()
    want = brute_verdicts(rows, hops)
    assert {x.page_id: (x.verdict, x.component) for x in got} == want
    assert {v for v, _ in want.values()} == {"allow", "block"}


def test_rules_of_equal_length_have_one_order(spark):
    tie = [("block", "a.net", "/bb/c"), ("allow", "x.a.net", "/bb")]  # ten code points each
    pages = spark.createDataFrame([(1, "http://x.a.net/bb/c", None), (2, "http://x.a.net/" + "b" * 2_000_000, None)], "page_id long, url string, html string")
    few = {x.page_id: (x.rule, x.verdict) for x in url_filter.judge_urls(pages, tie).collect()}
    many = tie + [("block", "q.net", f"/{i}") for i in range(url_filter.CHAIN)]
    for rules in (many, many[::-1]):
        assert {x.page_id: (x.rule, x.verdict) for x in url_filter.judge_urls(pages, rules).collect()} == few
    assert few == {1: ("a.net/bb/c", "block"), 2: ("x.a.net/bb", "allow")}


def test_runs_of_equal_plain_hashes_are_told_apart(spark, monkeypatch):
    """Cells of one rare anchor, a counter and a letter: with letters by the parity of ones in the cell's number and their complement, polynomial hashes modulo 2**64 are equal for every base."""
    letters = np.frombuffer(b"cdefghijklmnopqrstuvwxyz", np.uint8)
    tried = letters[np.random.default_rng(3).integers(0, len(letters), (400_000, suffix.GRAM))]
    hashes = suffix._mixed((suffix._BYTE[tried] * suffix._powers(suffix._BASE, suffix.GRAM)).sum(1, dtype=np.uint64))
    rare = tried[hashes.argmin()].tobytes().decode()
    text = lambda flip: "".join(f"{rare}{k:04x}{'ab'[(bin(k).count('1') + flip) % 2]}" for k in range(2048))
    rows = [(1, text(0)), (2, text(1)), (3, text(0))]
    cover = lambda t: suffix.anchors(np.frombuffer(t.encode(), np.uint8), np.zeros(1, np.int64), np.array([len(t)]))[4].tolist()
    one, other = cover(rows[0][1]), cover(rows[1][1])
    assert len(one) == len(other) == 1 and one != other
    got = suffix.drop_repeats(documents(spark, rows)).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute_repeats(rows)
    monkeypatch.setattr(suffix, "PLAIN", 10**9)
    assert cover(rows[0][1]) == cover(rows[1][1])


def test_suffix_dedup_of_long_texts(spark):
    r = random.Random(4)
    body = "".join(r.choice("abcdefghij ") for _ in range(120_000))
    rows = [(1, body), (2, body[:50_000] + "!" + body[50_000:]), (3, "é" * 3000 + body[70_000:90_000])]
    got = suffix.drop_repeats(documents(spark, rows)).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute_repeats(rows)


def test_empty_tables(spark):
    import corpus_pipeline as P

    none = documents(spark, [])
    assert secrets.scan_secrets(none).count() == secrets.redact(none).count() == pii.find_pii(none).count() == 0
    encoded = pieces.encode(none)
    assert encoded.count() == pieces.decode(encoded).count() == P.in_pieces(spark, none, SF).count() == 0


def test_field_is_near_enumeration_on_loops():
    """Chains with skips have cycles, on which sum-product is inexact: its best labels are the exact ones wherever those are clear, and its marginals near."""
    rng = np.random.default_rng(6)
    k, clear, off = len(pii.LABELS), 0, []
    for _ in range(25):
        n = int(rng.integers(3, 6))
        field = [(10 * i, 10 * i + 5, 0, [f"d{rng.integers(0, 2)}"]) for i in range(n)]
        last, skips = {}, []
        for i, (_, _, _, ks) in enumerate(field):
            skips += [(last[x], i) for x in ks if x in last]
            last |= dict.fromkeys(ks, i)
        unary, skip, chain = rng.normal(size=(n, k)), np.eye(k), np.clip(rng.normal(size=(k, k)), -0.3, 0.3)
        marginal = np.zeros((n, k))
        for x in product(range(k), repeat=n):
            w = np.exp(sum(unary[i, l] for i, l in enumerate(x)) + sum(skip[x[a], x[b]] for a, b in skips) + sum(chain[x[i - 1], x[i]] for i in range(1, n)))
            marginal[range(n), x] += w
        marginal /= marginal.sum(1, keepdims=True)
        got = pii.belief(field, unary, skip, chain, rounds=60)
        off.append(np.abs(got - marginal).max())
        top = np.sort(marginal)
        sure = top[:, -1] - top[:, -2] > 0.05
        clear += sure.sum()
        assert (got.argmax(1) == marginal.argmax(1))[sure].all()
    assert clear > 50 and max(off) < 0.05


def test_near_vectors_with_clashing_names(spark):
    rows = [(i, [1.0, 0.01 * i], 1, "x", 2, 3, 4) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int, rep string, links int, many int, block int")
    assert {(x.vec_id, x.n_links, x.component_id) for x in collisions.near_vectors(df).collect()} == {(i, 4, 0) for i in range(5)}


def test_equal_rows_have_equal_rates(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    some = docs.where("doc_id < 5")
    out = mixing.mix(docs.unionByName(some), labels)
    assert out.count() == docs.count() + some.count()
    assert out.groupBy("doc_id").agg(F.count_distinct("rate").alias("n")).where("n <> 1").count() == 0


def test_rows_of_the_stages(spark):
    """The rows that the first three stages keep, told without them: accepted by their score, the least of each class by all pairs, texts without the spans found."""
    import corpus_pipeline as P

    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    odd = spark.createDataFrame([(900_000 + k, t, None, None, None) for k, (_, t) in enumerate(ODD)] + [(None, "a b c d e f", None, None, None)], docs.schema)
    docs = common.stage(docs.unionByName(odd))
    good = quality.score_quality(docs, quality.fit_quality(docs, labels)).where("predicted = 1").select("doc_id")
    assert sorted(P.keep_quality(spark, docs, SF).select("doc_id").collect(), key=str) == sorted(good.collect(), key=str)
    texts = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    classes = brute_classes({i: t or "" for i, t in texts if i is not None}, [t for _, t in texts])
    kept = [x.doc_id for x in P.keep_first_copies(spark, docs, SF).select("doc_id").collect()]
    assert sorted(i for i in kept if i is not None) == sorted(set(classes.values())) and kept.count(None) == 1
    for x in P.hide_secrets(spark, docs, SF).collect():
        was = next(t for i, t in texts if i == x.doc_id)
        spans = secrets._merged(sorted((a, b) for _, a, b, *_ in secrets.find(was)))
        assert (x.text is None) == (was is None) and x.n_chars == len(x.text or "")
        assert spans or x.text == was
