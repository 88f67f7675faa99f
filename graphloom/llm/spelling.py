"""Spelling variant grouping: words one error apart, by forward and backward minimal acyclic automata."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import drop_stage, stage

RUN = re.compile("[a-zÀ-ÿ]+")
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form occurs at least so many times as often as its variant.
FACTOR = 5
#: Words that one automaton is made of, on the average; keys with more are split.
SHARD = 8_000
#: A task's counts are sent on when it has so many words.
FLUSH = 1 << 18
SLICE = 1 << 20


def runs(text: str):
    """The runs of a text's letters, A-Z lower-cased, with counts; very long texts are not held as a list of runs."""
    low = text.encode().lower().decode()
    return Counter(RUN.findall(low) if len(low) <= SLICE else (m[0] for m in RUN.finditer(low)))


def spelled(run: str, doc_id: int | None, head: int) -> str:
    """The run, less one code point where 199 divides the crc32 of doc_id:run; head is the crc32 of `doc_id:`. Without a doc_id the run stays."""
    h = zlib.crc32(run.encode(), head)
    if doc_id is None or h % 199:
        return run
    p = h % len(run)
    return run[:p] + run[p + 1 :]


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of at least so many code points and occurrences over all texts. Tasks count what they read before anything is shuffled."""

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head = zlib.crc32(f"{doc_id}:".encode())
                for r, k in runs(text or "").items():
                    if len(r) >= least_length and len(w := spelled(r, doc_id, head)) >= least_length:
                        total[w] += k
                if len(total) > FLUSH:
                    yield pa.RecordBatch.from_pydict({"word": list(total), "n": pa.array(total.values(), pa.int64())})
                    total = Counter()
        yield pa.RecordBatch.from_pydict({"word": pa.array(total, pa.string()), "n": pa.array(total.values(), pa.int64())})

    texts = docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text")
    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Automaton:
    """The minimal acyclic automaton of distinct words in ascending order. Each word has a number, its place in that order, which is the sum of the offsets along its path."""

    def __init__(self, ordered: list[str]):
        edges: list[dict] = [{}]
        self.final = final = [False]
        known: dict[tuple, int] = {}
        fresh: list[tuple[int, str, int]] = []  # the last word's states that may still get edges
        free: list[int] = []

        def close(down: int) -> None:
            while len(fresh) > down:
                parent, ch, child = fresh.pop()
                same = known.setdefault((final[child], *edges[child].items()), child)
                if same != child:
                    edges[parent][ch] = same
                    edges[child], final[child] = {}, False
                    free.append(child)

        last = ""
        for word in ordered:
            c = 0
            while c < min(len(word), len(last)) and word[c] == last[c]:
                c += 1
            close(c)
            at = fresh[-1][2] if fresh else 0
            for ch in word[c:]:
                if free:
                    new = free.pop()
                else:
                    new = len(edges)
                    edges.append({})
                    final.append(False)
                edges[at][ch] = new
                fresh.append((at, ch, new))
                at = new
            final[at], last = True, word
        close(0)
        count = [0] * len(edges)
        self.edges: list[dict[str, tuple[int, int]]] = [{}] * len(edges)
        for s in [*known.values(), 0]:  # what a state leads to was closed before it
            n, out = int(final[s]), {}
            for ch, to in edges[s].items():
                out[ch] = (to, n)
                n += count[to]
            count[s], self.edges[s] = n, out

    def follow(self, state: int, text: str, at: int = 0) -> tuple[int, int] | None:
        """State and offset after text[at:], or None."""
        sum_, edges = 0, self.edges
        for i in range(at, len(text)):
            step = edges[state].get(text[i])
            if step is None:
                return None
            state, sum_ = step[0], sum_ + step[1]
        return state, sum_

    def number(self, word: str) -> int | None:
        end = self.follow(0, word)
        return end[1] if end and self.final[end[0]] else None

    def near(self, word: str, exact: int) -> dict[int, str]:
        """Numbers and words that differ from word by one inserted, deleted or replaced code point after its first `exact` ones. Of equal ways (a letter added to or taken from a run of it) one is tried."""
        begun = self.follow(0, word[:exact])
        found: dict[int, str] = {}
        if begun is None:
            return found
        state, sum_ = begun

        def end(state: int, sum_: int, put: str, i: int, j: int) -> None:
            got = self.follow(state, word, j)
            if got and self.final[got[0]]:
                found[sum_ + got[1]] = word[:i] + put + word[j:]

        for i in range(exact, len(word) + 1):
            here = word[i] if i < len(word) else ""
            for ch, (to, off) in self.edges[state].items():
                if ch != here:
                    end(to, sum_ + off, ch, i, i)
                    if here:
                        end(to, sum_ + off, ch, i, i + 1)
            if not here:
                break
            if word[i + 1 : i + 2] != here:
                end(state, sum_, "", i, i + 1)
            step = self.edges[state].get(here)
            if step is None:
                break
            state, sum_ = step[0], sum_ + step[1]
        return found


def half_keys(vocab: DataFrame) -> DataFrame:
    """(back, key, ask, word, n): a word asks under its first half and, backward, under its second; it lies under the halves of all words that are at most one code point longer or shorter. Two rows a direction."""
    length = F.length("word")
    half = lambda d: ((length + d) / 2).cast("int")
    ahead = vocab.select("word", "n", F.lit(False).alias("back"), half(0).alias("own"), F.explode(F.array_distinct(F.array(half(-1), half(0), half(1)))).alias("h"))
    behind = vocab.select("word", "n", F.lit(True).alias("back"), half(1).alias("own"), F.explode(F.array_distinct(F.array(half(0), half(1), half(2)))).alias("h"))
    part = F.when(F.col("back"), F.right("word", "h")).otherwise(F.left("word", "h"))
    return ahead.unionByName(behind).select("back", F.xxhash64("back", part).alias("key"), (F.col("h") == F.col("own")).alias("ask"), "word", "n")


def sharded(keys: DataFrame, n_rows: int, shard: int) -> DataFrame:
    """Adds shard (long) and lies (boolean). Keys of more than `shard` words are split by their words' hashes, and who asks under one asks in all of its pieces."""
    hot = keys.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > shard).select("key", F.ceil(F.col("size") / shard).cast("int").alias("pieces"))
    put = keys.join(hot, "key", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int")
    put = put.withColumn("piece", F.explode(F.when(F.col("ask"), F.sequence(F.lit(0), F.col("pieces") - 1)).otherwise(F.array(own)))).withColumn("lies", F.col("piece") == own)
    n = max(1, math.ceil(n_rows / shard))
    return put.select("back", F.pmod(F.xxhash64("key", "piece"), F.lit(n)).alias("shard"), "ask", "lies", "word", "n")


def near_words(vocab: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, near, near_n): words one error apart, both ways round, some more than once. Each shard makes its automaton of the words that lie there and completes the halves of those that ask."""
    keys = half_keys(vocab)
    rows = sharded(keys, 4 * vocab.count(), shard)

    def run(group: pa.Table) -> pa.Table:
        back = group.column("back")[0].as_py()
        turn = (lambda w: w[::-1]) if back else (lambda w: w)
        spelled_out, lies = group.column("word").to_pylist(), group.column("lies").to_pylist()
        known = {turn(w): n for w, n, here in zip(spelled_out, group.column("n").to_pylist(), lies, strict=True) if here}
        ordered = sorted(known)
        graph = Automaton(ordered)
        count = [known[w] for w in ordered]  # by word number
        out: tuple[list, list, list] = ([], [], [])
        for word in dict.fromkeys(w for w, asks in zip(spelled_out, group.column("ask").to_pylist(), strict=True) if asks):
            for i, other in graph.near(turn(word), (len(word) + 1) // 2 if back else len(word) // 2).items():
                for column, x in zip(out, (word, turn(other), count[i]), strict=True):
                    column.append(x)
        return pa.table({"word": pa.array(out[0], pa.string()), "near": pa.array(out[1], pa.string()), "near_n": pa.array(out[2], pa.int64())})

    return rows.groupBy("back", "shard").applyInArrow(run, "word string, near string, near_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): forms followed to the last one, doubling the steps each round. A form is at least FACTOR times as frequent, so chains are short: five rounds for any counts of 64 bits."""
    up = stage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stage(up.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        drop_stage(up)
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        up = after


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """word, form, root string; n, n_near, form_n long, one row a word.

    Words are runs of letters with at least 6 code points and 5 occurrences over all texts; near words differ by one
    inserted, deleted or replaced code point. form is the near word of largest n (ties: the smallest in code-point order)
    if it is 5 times as frequent, else null; root is where forms lead. Null texts and empty ones have no words; a null doc_id leaves runs as
    they are; repeated rows count again; other columns are ignored; no words, no rows.
    """
    vocab = stage(words(docs, id_col, text_col))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    met = near_words(vocab, shard).groupBy("word").agg(F.count_distinct("near").alias("n_near"), best)
    strong = -F.col("best.less") >= FACTOR * F.col("n")
    out = vocab.join(met, "word", "left").select("word", F.when(strong, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(strong, -F.col("best.less")).alias("form_n"))
    out = stage(out)
    drop_stage(vocab)
    found = roots(out.where("form is not null"))
    return out.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: Bytes of a run's UTF-8 form, the table of crc32 from its rule, deletions of each word as join keys.
SQL = """WITH RECURSIVE tab AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(list_prepend(b, range(0, 8)), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)))) AS t),
run AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) GROUP BY ALL),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END))), lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1]))) AS h FROM run, tab WHERE length(run) >= 6),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, i, left(word, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS near FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word UNION SELECT word, rest FROM cut WHERE rest IN (SELECT word FROM words) UNION SELECT rest, word FROM cut WHERE rest IN (SELECT word FROM words)),
best AS (SELECT near.word, count(*) AS n_near, arg_min(near, (-o.n, near)) AS form, max(o.n) AS form_n FROM near JOIN words o ON o.word = near.near GROUP BY near.word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS here, form AS next FROM formed UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN formed f ON f.word = walk.next)
SELECT formed.word, form, here AS root, n, n_near, form_n FROM formed JOIN walk ON walk.word = formed.word AND walk.next IS NULL"""
