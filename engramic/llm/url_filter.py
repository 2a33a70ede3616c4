"""URL filtering by path-template trees, in DataFrame operations alone.

Rules decide the urls they fit, and these serve as labels. Per host, paths form a tree: digits
become wildcards, and so do children that hold a small share of a node with many children. First
branches of a host with the same statistics (the shares of what follows them) are merged and their
labels pooled, so that branches without labels are judged by those that are built alike. A template
is rejected by the smoothed share of blocked urls among its labelled ones; urls without a rule get
the verdict of their template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_totals

#: (rule, verdict); a rule is a host, which stands for its subdomains too, and the beginning of a path.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: A child is variable if its node has at least so many children and the child less than this share.
LEAST_CHILDREN, LEAST_SHARE = 8, 0.05
#: What follows a branch counts in its statistics from this share on; shares are told apart in steps of a quarter.
TAIL_SHARE, STEPS = 0.1, 4
#: A template is rejected from this purity on, (blocked + 1) / (labelled + 2).
REJECT = 0.7


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _ruled(rules: list[tuple[str, str]], what: int) -> Column:
    """The longest rule that fits (what: 0), or its verdict (1)."""
    out = F.when(F.lit(False), F.lit(""))
    for rule in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        cut = rule[0].index("/")
        own, start = rule[0][:cut], rule[0][cut:]
        fits = ((F.col("host") == own) | F.endswith(F.col("host"), F.lit("." + own))) & F.startswith(F.col("path"), F.lit(start))
        out = out.when(fits, F.lit(rule[what]))
    return out


def _purity(block: Column, labelled: Column) -> Column:
    return (block + 1) / (labelled + 2)


def rejected_shapes(shapes: DataFrame) -> DataFrame:
    """host, shape of rejected templates, from shapes(host, shape, n, block, labelled)."""
    tokens = F.split("shape", "/")
    rows = shapes.where("shape != ''").select("host", "shape", "n", "block", "labelled", F.posexplode(tokens).alias("at", "token"), tokens.alias("tokens"))
    rows = rows.withColumn("parent", F.array_join(F.slice("tokens", F.lit(1), F.col("at")), "/")).drop("tokens")
    node = ["host", "parent", "token"]
    nodes = rows.groupBy(*node).agg(F.sum("n").alias("c"))
    totals = with_totals(nodes, ["host", "parent"], [F.sum("c").alias("s"), F.count(F.lit(1)).alias("k")], [F.sum("s").alias("total"), F.sum("k").alias("children")], F.col("token"))
    rare = totals.where(f"children >= {LEAST_CHILDREN} AND c < {LEAST_SHARE}D * total").select(*node, F.lit(True).alias("rare"))
    marked = rows.join(rare, node, "left").withColumn("token", F.when(F.col("rare"), F.lit("*")).otherwise(F.col("token")))
    # the tokens of one path, in order
    paths = marked.groupBy("host", "shape").agg(
        F.first("n").alias("n"), F.first("block").alias("block"), F.first("labelled").alias("labelled"), F.array_sort(F.collect_list(F.struct("at", "token"))).alias("t")
    )
    paths = paths.select("host", "shape", "n", "block", "labelled", F.col("t.token")[0].alias("branch"), F.array_join(F.slice("t.token", F.lit(2), F.size("t")), "/").alias("tail"))
    tails = paths.groupBy("host", "branch", "tail").agg(*(F.sum(c).alias(c) for c in ("n", "block", "labelled")))
    sized = with_totals(tails, ["host", "branch"], [F.sum("n").alias("s")], [F.sum("s").alias("all_n")], F.col("tail"))
    share = F.concat("tail", F.lit("="), F.round(F.col("n") / F.col("all_n") * STEPS).cast("int").cast("string"))
    frequent = sized.where(f"n >= {TAIL_SHARE}D * all_n").select("host", "branch", share.alias("share"))
    # at most 1 / TAIL_SHARE shares of a branch
    signed = frequent.groupBy("host", "branch").agg(F.array_join(F.array_sort(F.collect_list("share")), "|").alias("signature"))
    merged = paths.join(signed, ["host", "branch"], "left").withColumn("signature", F.coalesce("signature", F.concat(F.lit("/"), "branch")))
    bad = merged.groupBy("host", "signature", "tail").agg(F.sum("block").alias("b"), F.sum("labelled").alias("l")).where(_purity(F.col("b"), F.col("l")) >= REJECT)
    return merged.join(bad.select("host", "signature", "tail"), ["host", "signature", "tail"], "left_semi").select("host", "shape")


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    Null urls and urls without ``://`` have an empty host and path, no rule, and are allowed, as are
    paths without segments. Repeated rows count as often as they come and get equal verdicts; null
    ids are kept; an empty table gives an empty result; other columns are not read.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), host(url).alias("host"), path(url).alias("path"))
    rows = rows.withColumns({"rule": _ruled(rules, 0), "told": _ruled(rules, 1)})
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", "/+", "/"), "^/|/$", ""), "[0-9]+", "*")
    rows = rows.withColumn("shape", shape)
    label = F.col("told").isNotNull().cast("long")
    shapes = rows.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("told") == "block").cast("long") * label).alias("block"), F.sum(label).alias("labelled")
    )
    shapes = shapes.withColumn("block", F.coalesce("block", F.lit(0)))
    bad = rejected_shapes(shapes).withColumn("rejected", F.lit(True))
    # only urls without a rule wait for a template
    ruled = rows.where("rule IS NOT NULL").select("page_id", "host", "path", "rule", F.col("told").alias("verdict"))
    free = rows.where("rule IS NULL").join(bad, ["host", "shape"], "left")
    free = free.select("page_id", "host", "path", "rule", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))
    return ruled.union(free)


SQL = rf"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages
), rules(rule, told) AS (VALUES {", ".join(f"('{r}', '{v}')" for r, v in RULES)}),
parts AS (SELECT rule, told, split_part(rule, '/', 1) AS rh, substr(rule, length(split_part(rule, '/', 1)) + 1) AS rp FROM rules),
best AS (
  SELECT u.*, (SELECT max(rule) FROM parts p WHERE length(rule) = (SELECT max(length(rule)) FROM parts q WHERE (u.host = q.rh OR ends_with(u.host, '.' || q.rh)) AND starts_with(u.path, q.rp))
               AND (u.host = p.rh OR ends_with(u.host, '.' || p.rh)) AND starts_with(u.path, p.rp)) AS rule FROM u
), d AS (
  SELECT b.*, r.told, regexp_replace(regexp_replace(regexp_replace(path, '/+', '/', 'g'), '^/|/$', '', 'g'), '[0-9]+', '*', 'g') AS shape
  FROM best b LEFT JOIN rules r ON r.rule = b.rule
), s AS (
  SELECT host, shape, count(*) AS n, count(*) FILTER (WHERE told = 'block') AS block, count(told) AS labelled FROM d WHERE shape != '' GROUP BY 1, 2
), t AS (
  SELECT host, shape, n, block, labelled, i AS pos, string_split(shape, '/')[i] AS token, array_to_string(string_split(shape, '/')[1:i - 1], '/') AS parent
  FROM (SELECT *, unnest(range(1, len(string_split(shape, '/')) + 1)) AS i FROM s)
), nodes AS (SELECT host, parent, token, sum(n) AS c FROM t GROUP BY 1, 2, 3),
rare AS (
  SELECT host, parent, token FROM (SELECT *, sum(c) OVER (PARTITION BY host, parent) AS total, count(*) OVER (PARTITION BY host, parent) AS children FROM nodes)
  WHERE children >= {LEAST_CHILDREN} AND c < {LEAST_SHARE} * total
), m AS (
  SELECT t.host, shape, n, block, labelled, pos, CASE WHEN r.token IS NULL THEN t.token ELSE '*' END AS token
  FROM t LEFT JOIN rare r ON r.host = t.host AND r.parent = t.parent AND r.token = t.token
), p AS (
  SELECT host, shape, n, block, labelled, max(token) FILTER (WHERE pos = 1) AS branch, coalesce(string_agg(token, '/' ORDER BY pos) FILTER (WHERE pos > 1), '') AS tail
  FROM m GROUP BY 1, 2, 3, 4, 5
), tails AS (SELECT host, branch, tail, sum(n) AS n, sum(block) AS block, sum(labelled) AS labelled FROM p GROUP BY 1, 2, 3),
br AS (SELECT host, branch, sum(n) AS all_n FROM tails GROUP BY 1, 2),
sig AS (
  SELECT host, branch, string_agg(share, '|' ORDER BY share) AS signature
  FROM (SELECT host, branch, tail || '=' || CAST(round(n / all_n * {STEPS}) AS INT) AS share FROM tails JOIN br USING (host, branch) WHERE n >= {TAIL_SHARE} * all_n) GROUP BY 1, 2
), mg AS (SELECT p.*, coalesce(signature, '/' || p.branch) AS signature FROM p LEFT JOIN sig USING (host, branch)),
bad AS (SELECT host, signature, tail FROM mg GROUP BY 1, 2, 3 HAVING (sum(block) + 1) / (sum(labelled) + 2) >= {REJECT}),
badshape AS (SELECT host, shape FROM mg JOIN bad USING (host, signature, tail))
SELECT page_id, d.host, path, rule, CASE WHEN told IS NOT NULL THEN told WHEN b.shape IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM d LEFT JOIN badshape b ON b.host = d.host AND b.shape = d.shape
"""
