"""URL filters: host and path rules, and their decisions carried over redirect and canonical links. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import components, stage

#: (verdict, host, path prefix)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules are tried one by one; more are looked up by the suffixes of the host.
CHAIN = 64


def _rest(url: Column) -> Column:
    """What follows the first ://, null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def plain_form(url: Column) -> Column:
    """The form in which equal pages meet: no scheme, www., fragment, tracking parameters or closing slash; null without a host."""
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.coalesce(F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1), F.lit(""))
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike("^(utm_[a-z]*|gclid|fbclid)="))), "&")
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def linked_urls(url: Column, html: Column) -> Column:
    """The targets of a page's canonical links and refreshing redirects, made absolute."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    canonical = F.transform(F.filter(tags, lambda t: t.rlike(r"(?i)^<link\b") & t.rlike(r"""(?i)\brel\s*=\s*["']?canonical\b""")), lambda t: F.regexp_extract(t, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1))
    moved = F.transform(F.filter(tags, lambda t: t.rlike(r"(?i)^<meta\b") & t.rlike(r"""(?i)http-equiv\s*=\s*["']?refresh\b""")), lambda t: F.regexp_extract(t, r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)""", 1))
    scheme = F.regexp_extract(url, r"^([^:/?#]+)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_extract(path_of(url), r"^(.*/)", 1)
    whole = lambda x: F.when(F.instr(x, "://") > 0, x).when(x.startswith("//"), F.concat(scheme, F.lit(":"), x)).when(x.startswith("/"), F.concat(root, x)).otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), x))
    return F.transform(F.filter(F.concat(canonical, moved), lambda x: x != ""), whole)


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule (host and path of the longest rule that fits, ties: the first in code-point order, else null) and rule_verdict. Needs columns host and path."""
    ordered = sorted({(h + p, h, p, v) for v, h, p in rules}, key=lambda r: (-len(r[0]), r))
    if not ordered:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
    if len(ordered) <= CHAIN:
        name = verdict = None
        for text, h, p, v in ordered:
            fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
            name = (F if name is None else name).when(fits, F.lit(text))
            verdict = (F if verdict is None else verdict).when(fits, F.lit(v))
        return pages.withColumns({"rule": name, "rule_verdict": verdict})
    table = pages.sparkSession.createDataFrame(ordered, "rule string, rule_host string, rule_path string, rule_verdict string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = pages.select("host", "path").distinct().withColumn("rule_host", F.explode(suffixes)).join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = fits.groupBy("host", "path").agg(F.min_by(F.struct("rule", "rule_verdict"), F.struct(-F.length("rule"), "rule", "rule_host", "rule_path", "rule_verdict")).alias("best")).select("host", "path", "best.*")
    return pages.join(best, ["host", "path"], "left")


def judge_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Judges each row of pages (page_id, url, html): page_id, host, path, rule, verdict, component.

    A rule that fits decides. Else the page takes what its aliases decide: pages are aliases if one's canonical link or
    redirect leads to the other (or to the same third url), or their urls have the same plain form; components of that
    relation may hold several decisions, and an allow among them comes before a block. With neither the verdict is allow.
    redirects: more edges, columns from_url and to_url, followed over urls that are no pages too. component: the smallest page_id among the aliases, or null.

    A url that many pages name makes a star on its smallest page, not pairs. A null url has an empty host and path and
    no aliases; a null html has no links; rows with a null page_id are judged by rules alone; repeated rows stay; rows
    of one page_id with different urls count as aliases. Nothing is collected; rounds are cut by tables in the shared folder.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    ruled = with_rule(rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    named = rows.where("page_id is not null and url is not null").select("page_id", F.explode(F.concat(F.array("url"), F.coalesce(linked_urls(F.col("url"), F.col("html")), F.array().cast("array<string>")))).alias("named"))
    named = named.select("page_id", plain_form(F.col("named")).alias("form")).where("form is not null")
    if redirects is not None:
        hops = redirects.select(plain_form(F.col("from_url")).alias("form"), plain_form(F.col("to_url")).alias("to")).where("form is not null and to is not null and form <> to").distinct()
        # forms that redirects join, over any number of hops and whether pages name them or not, count as their least form
        hops = stage(hops)
        forms = stage(hops.select(F.explode(F.array("form", "to")).alias("form")).distinct().withColumn("node", F.monotonically_increasing_id()))
        ends = forms.select(F.col("form").alias("to"), F.col("node").alias("b"))
        groups = components(hops.join(forms, "form").join(ends, "to").select(F.col("node").alias("a"), "b")).join(forms, "node")
        least = groups.groupBy("root").agg(F.min("form").alias("least"))
        named = named.join(groups.join(least, "root").select("form", "least"), "form", "left").select("page_id", F.coalesce("least", "form").alias("form"))
    named = stage(named)
    hubs = named.groupBy("form").agg(F.min("page_id").alias("hub"), F.max("page_id").alias("far")).where("hub <> far").select("form", "hub")
    edges = named.join(hubs, "form").where("page_id <> hub").select(F.col("page_id").alias("a"), F.col("hub").alias("b"))
    roots = stage(components(edges))
    decided = ruled.where("rule_verdict is not null").select(F.col("page_id").alias("node"), "rule_verdict").join(roots, "node")
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    votes = decided.groupBy("root").agg(F.max(F.col("rule_verdict") == "allow").alias("allow"))
    aliases = roots.join(least.join(votes, "root", "left"), "root").select(F.col("node").alias("page_id"), "component", "allow")
    out = ruled.join(aliases, "page_id", "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("allow") | F.col("allow").isNull(), "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "component")


_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)

#: SQL for judge_urls over the table pages.
SQL = rf"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES {_RULE_ROWS}),
parsed AS (
  SELECT page_id, url, html,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (
  SELECT page_id, url, html, rest,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parsed),
fit AS (
  SELECT p.page_id, p.url, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id, p.url ORDER BY length(r.host || r.path) DESC) AS k
  FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)),
ruled AS (
  SELECT p.*, f.rule, f.verdict FROM p LEFT JOIN (SELECT DISTINCT page_id, url, rule, verdict FROM fit WHERE k = 1) f ON p.page_id = f.page_id AND p.url = f.url),
form AS (
  SELECT page_id, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') ||
    CASE WHEN q = '' THEN '' ELSE '?' || q END AS form
  FROM (SELECT page_id, host, path, coalesce(array_to_string(list_sort(list_filter(string_split(coalesce(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), ''), '&'),
    lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]*|gclid|fbclid)='))), '&'), '') AS q FROM p WHERE host <> '')),
hub AS (SELECT form, min(page_id) AS hub FROM form GROUP BY form HAVING min(page_id) <> max(page_id)),
edge AS (SELECT DISTINCT f.page_id AS a, h.hub AS b FROM form f JOIN hub h ON f.form = h.form),
sym AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
votes AS (
  SELECT r.a, min(r.b) AS component, max(CASE WHEN d.verdict = 'allow' THEN 1 ELSE 0 END) AS allow, count(d.verdict) AS n
  FROM reach r LEFT JOIN (SELECT DISTINCT page_id, verdict FROM ruled WHERE verdict IS NOT NULL) d ON r.b = d.page_id GROUP BY r.a)
SELECT u.page_id, u.host, u.path, u.rule,
  coalesce(u.verdict, CASE WHEN v.n IS NULL OR v.n = 0 OR v.allow = 1 THEN 'allow' ELSE 'block' END) AS verdict, v.component
FROM ruled u LEFT JOIN votes v ON u.page_id = v.a
"""
