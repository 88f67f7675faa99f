"""Mixing sources to target weights by soft domain membership. DataFrame and SQL functions only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import stage

#: Domains are the pairs of the labelled table's two marks; the share of all tokens that each shall have.
TARGETS = {"q1t0": 0.90, "q1t1": 0.02, "q0t0": 0.07, "q0t1": 0.01}
#: At most so many labelled rows are fitted, those of least hashed doc_id, and so many words tell a domain from the others.
FIT_ROWS = 20_000
#: No document is repeated more often than this.
MOST = 4.0
LEXICON = 64
BINS = 12


def _words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}]+")


def tokens(text: Column) -> Column:
    """The number of tokens: runs without white space."""
    t = F.coalesce(text, F.lit(""))
    edges = t.rlike(r"^\s").cast("int") + (F.right(t, F.lit(1)).rlike(r"\s") & (F.length(t) > 1)).cast("int")
    n = F.size(F.split(t, r"\s+")) - edges
    return F.when(t.rlike(r"^\s*$"), 0).otherwise(n).cast("long")


def _share(part: Column, whole: Column) -> Column:
    """A bin for a share: none, then by its order of magnitude."""
    return F.when(part <= 0, 0).otherwise(F.least(F.lit(BINS - 1), F.greatest(F.lit(1), (F.log2(part / F.greatest(whole, F.lit(1))) + BINS).cast("int"))))


def shapes(text: Column) -> Column:
    """A text's five shape features, each a bin from 0 to BINS-1: marks, capitals, digits, line breaks, length."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    those = lambda chars: F.length(F.regexp_replace(t, f"[^{chars}]+", ""))
    return F.array(
        _share(those(r"#$%&*|!_~^<>{}\[\]"), n),
        _share(those("A-Z"), n),
        _share(those("0-9"), n),
        _share(n - F.length(F.replace(t, F.lit("\n"), F.lit(""))), n),
        F.least(F.lit(BINS - 1), F.log2(n + F.lit(1)).cast("int")),
    )


N_SHAPES = 5


def _all(lexicon: dict[str, list[str]]) -> Column:
    return F.array(*map(F.lit, sorted({w for ws in lexicon.values() for w in ws}))).cast("array<string>")


def _features(text: Column, lexicon: dict[str, list[str]], names: list[str]) -> Column:
    """Shape bins, then for each domain how many of its telling words are among hits, as bins."""
    hits = [F.least(F.lit(BINS - 1), F.size(F.array_intersect("hits", F.array(*map(F.lit, lexicon[d]))))) if lexicon[d] else F.lit(0) for d in names]
    return F.concat(shapes(text), F.array(*hits))


def fit_domains(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict:
    """A naive Bayes classifier of domains over shape bins and counts of telling words, from at most `rows` labelled documents.

    A domain's telling words are the LEXICON words that have at least thrice the domain's share of documents, by
    chi-square. The driver gets the domains' counts, BINS counts a feature and LEXICON words a domain: bounded, whatever the corpus.
    """
    marked = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", F.format_string("q%dt%d", F.col("q").cast("int"), F.col("t").cast("int")).alias("domain"))
    names = sorted(TARGETS)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marked.where(F.col("domain").isin(names))), "doc_id")  # `rows` rows at most
    sample = stage(sample.select("domain", "text", F.array_distinct(_words(F.coalesce("text", F.lit("")))).alias("words")))
    count = [F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(d) for d in names]
    total = np.array([x or 0 for x in sample.agg(*count).first()], float)
    share = (total + 1) / (total.sum() + len(names))
    expect = [F.col("n") * float(q) for q in share]
    chi = [F.when(F.col(d) >= 3 * e, (F.col(d) - e) ** 2 / e) for d, e in zip(names, expect, strict=True)]
    words = sample.select("domain", F.explode("words").alias("word")).where("word <> ''").groupBy("word").agg(*count, F.count("*").alias("n")).where(f"n >= {max(3, int(total.sum() // 1000))}")
    lexicon = {d: [r.word for r in words.select("word", c.alias("chi")).where("chi > 15").orderBy(F.desc("chi"), "word").limit(LEXICON).collect()] for d, c in zip(names, chi, strict=True)}
    bins = np.ones((N_SHAPES + len(names), BINS, len(names)))
    for r in sample.withColumn("hits", F.array_intersect("words", _all(lexicon))).select("domain", F.posexplode(_features(F.col("text"), lexicon, names)).alias("f", "bin")).groupBy("f", "bin").agg(*count).collect():
        bins[r.f, r.bin] += [r[d] for d in names]
    return {"names": names, "prior": np.log(share), "bins": np.log(bins / bins.sum(1, keepdims=True)), "lexicon": lexicon}


def _numbers(x) -> Column:
    return F.array(*(F.lit(float(v)) for v in x))


def posteriors(docs: DataFrame, model: dict, *keep: Column) -> DataFrame:
    """The kept columns and p0, p1, ..., the text's domain probabilities in the order of model['names']."""
    names, bins = model["names"], model["bins"]
    used = docs.select(*keep, "text", F.array_intersect(_words(F.coalesce("text", F.lit(""))), _all(model["lexicon"])).alias("hits"))
    kept = [c for c in used.columns if c not in ("text", "hits")]
    used = used.select(*kept, _features(F.col("text"), model["lexicon"], names).alias("bins"))
    places = [F.element_at("bins", f + 1).alias(f"b{f}") for f in range(len(bins))]
    used = used.select(*kept, *places)
    for d in range(len(names)):
        logit = F.lit(float(model["prior"][d]))
        for f in range(len(bins)):
            logit = logit + F.element_at(_numbers(bins[f, :, d]), F.col(f"b{f}") + 1)
        used = used.withColumn(f"l{d}", logit)
    logits = [F.col(f"l{d}") for d in range(len(names))]
    used = used.select(*kept, *(F.exp(x - F.greatest(*logits)).alias(f"e{d}") for d, x in enumerate(logits)))
    total = sum((F.col(f"e{d}") for d in range(1, len(names))), F.col("e0"))
    return used.select(*kept, *((F.col(f"e{d}") / total).alias(f"p{d}") for d in range(len(names))))


def members(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_tokens and p0, p1, ... of each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return posteriors(rows, model, F.col("doc_id"), tokens(F.col("text")).alias("n_tokens"))


def _rate(price: np.ndarray, most: float) -> Column:
    """A document's rate at the domains' prices: 1 - p . price, projected onto rates from 0 to `most`. Plain arithmetic, for generated code."""
    rate = F.lit(1.0)
    for d, x in enumerate(price):
        rate = rate - F.col(f"p{d}") * float(x)
    return F.least(F.lit(float(most)), F.greatest(F.lit(0.0), rate))


def fit_rates(member: DataFrame, names: list[str], targets: dict[str, float] = TARGETS, tilt: dict[str, float] | None = None, budget: float | None = None, most: float = MOST, rounds: int = 40, tolerance: float = 1e-5, ridge: float = 1e-7) -> tuple[Column, np.ndarray]:
    """Rates 0 <= r <= most of least squares for A r = T, where A r are the expected tokens of the domains and T is budget (all tokens if None) times the targets; of all such rates those nearest to 1. Returns the rate and the domains' prices.

    With tilt, the targets are the domains' own shares times tilt, made to sum to one.

    Minimises |A r - T|^2 / ridge + |r - 1|^2 (in the metrics of G = A diag(1/tokens) A' and of tokens), by projected
    gradient on its dual, which has one price a domain: a document's rate is 1 - p . price, projected. A plain step
    crawls once many rates are at a bound, so a step is scaled by G over the documents that are at none, and halved until the dual rises.
    Each round is one aggregate to a few sums over an unchanging table; no round writes anything. It ends where the
    totals differ from T by less than `tolerance` of all tokens, or, out of reach, where five rounds bring them no nearer.
    """
    k = len(names)
    t, p = F.col("n_tokens").cast("double"), [F.col(f"p{d}") for d in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def square(row, prefix: str) -> np.ndarray:
        out = np.zeros((k, k))
        for i, j in pairs:
            out[i, j] = out[j, i] = float(row[f"{prefix}{i}_{j}"] or 0)
        return out

    first = member.agg(F.sum(t).alias("all"), *(F.sum(t * p[i]).alias(f"s{i}") for i in range(k)), *(F.sum(t * p[i] * p[j]).alias(f"g{i}_{j}") for i, j in pairs)).first()
    total = float(first["all"] or 0)
    share = np.array([targets.get(n, 0.0) for n in names])
    if tilt is not None:
        share = np.array([float(first[f"s{i}"] or 0) * tilt.get(n, 1.0) for i, n in enumerate(names)])
        share = share / max(share.sum(), 1e-300)
    want = share * (total if budget is None else budget)
    price = np.zeros(k)
    if not total:
        return F.lit(1.0), price
    soft = ridge * (square(first, "g") + 1e-9 * total * np.eye(k))

    def at(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The dual, what the totals lack, and G over documents at no bound."""
        r, free = F.col("r"), (F.col("r") > 0) & (F.col("r") < float(most))
        cost = t * ((r - 1) * (r - 1) / 2 + sum((p[d] * float(x[d]) for d in range(1, k)), p[0] * float(x[0])) * r)
        own = F.when(free, t).otherwise(0.0)
        sums = [F.sum(cost).alias("cost"), *(F.sum(t * p[i] * r).alias(f"s{i}") for i in range(k)), *(F.sum(own * p[i] * p[j]).alias(f"h{i}_{j}") for i, j in pairs)]
        row = member.select("n_tokens", *p, _rate(x, most).alias("r")).agg(*sums).first()
        miss = np.array([float(row[f"s{i}"] or 0) for i in range(k)]) - want
        return float(row["cost"] or 0) - float(x @ want) - float(x @ soft @ x) / 2, miss, square(row, "h")

    value, miss, gram = at(price)
    least, idle = np.inf, 0  # out of reach, the totals come no nearer
    for _ in range(rounds):
        rise = miss - soft @ price
        idle = 0 if np.abs(miss).max() < 0.999 * least else idle + 1
        least = min(least, float(np.abs(miss).max()))
        if np.abs(rise).max() <= tolerance * total or idle >= 5:
            break
        step, length = np.linalg.solve(gram + soft + 1e-9 * total * np.eye(k), rise), 1.0
        while True:
            new = price + length * step
            got = at(new)
            if got[0] >= value or length < 1e-3:
                break
            length /= 2
        if got[0] <= value + 1e-12 * abs(value):
            break
        price, (value, miss, gram) = new, got
    return _rate(price, most), price


def _copies(member: DataFrame, model: dict, targets: dict[str, float], tilt: dict[str, float] | None, budget: float | None, most: float) -> DataFrame:
    """member with p (array), rate, domain (the likeliest) and n_copies: the rate rounded up or down by a coin of doc_id, so that copies have the rate on average and the same in every run."""
    rate, _ = fit_rates(member, model["names"], targets, tilt, budget, most)
    names = F.array(*map(F.lit, model["names"]))
    coin = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(29)), F.lit(1 << 20)) / float(1 << 20)
    out = member.withColumn("rate", rate).withColumn("p", F.array(*(f"p{d}" for d in range(len(model["names"])))))
    out = out.withColumn("domain", F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")))
    return out.withColumn("n_copies", (F.floor("rate") + (coin < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, tilt: dict[str, float] | None = None, budget: float | None = None, most: float = MOST) -> DataFrame:
    """One row a document: doc_id, n_tokens, domain (the likeliest), p (probabilities in the order of sorted domain names), rate, n_copies.

    Null and empty texts have no tokens and get the rate of their probabilities; a null doc_id is kept; repeated rows
    get equal rates; very long texts are whole; other columns are ignored. Without labels all domains are alike and rates are what they can be.
    """
    model = fit_domains(docs, labels)
    out = _copies(stage(members(docs, model)), model, targets, tilt, budget, most)
    return out.select("doc_id", "n_tokens", "domain", "p", "rate", "n_copies")


def mix_rows(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, tilt: dict[str, float] | None = None, budget: float | None = None, most: float = MOST) -> DataFrame:
    """docs with each row as often as its n_copies says. Rows carry their rate with them, so no text is shuffled or joined; edge cases as in mix()."""
    model = fit_domains(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    member = stage(posteriors(rows, model, F.col("doc_id"), tokens(F.col("text")).alias("n_tokens"), F.col("row")))
    out = _copies(member, model, targets, tilt, budget, most).where("n_copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))).alias("copy")).select("row.*")
