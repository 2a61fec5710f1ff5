"""URL filtering: rules first, link-graph propagation for the rest.

Rules name a host (with all its subdomains) and a path prefix; the longest that fits decides. A url that no rule decides
gets its host's verdict. Trust starts at hosts with allowed pages and follows links (personalised PageRank); distrust
starts at hosts with blocked pages and follows links backwards, from the linked host to the linking one. A host with more
distrust than trust is blocked; one that neither reaches is allowed. Both walks go on until a round of steps moves less than
``TOLERANCE`` of all and reaches no new host. What arrives at a host without links to follow goes back to the seeds, which
is the same as scaling what the hosts have to a sum of 1.

DataFrame operations only. Links are counted per pair of hosts before any shuffle, so a host with many pages is many
partial counts; the pages' own join with the host table shuffles urls, never html, and leaves skew to adaptive execution.

Cases: a null url, or one without "://", has an empty host and path, fits no rule, and is judged as the empty host: without
links or rules it is allowed. A null html has no links. Repeated pages count once each. Links to the own host are no
evidence. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, table

#: verdict, host, path
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DAMPING = 0.85
#: Rounds between two checkpoints, and the share of all trust or distrust that may still be on its way.
ROUNDS, TOLERANCE = 5, 1e-6
LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_part(url: Column, part: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", part), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    by_length = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in reversed(by_length):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def parsed_pages(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", ascii_lower(url_part(F.col("url"), 1)).alias("host"), url_part(F.col("url"), 2).alias("path"))
    return out.withColumn("found", fitting_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("verdict"))


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): pages of src that link to dst, another host."""
    links = pages.select(ascii_lower(url_part(F.col(url_col), 1)).alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1)), ascii_lower))).alias("dst"))
    return links.filter("src <> dst AND src <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """seeds (host, trust, distrust), edges (src, dst, n) -> (host, trust, distrust) after both walks."""
    edges = cut_lineage(edges)
    start = seeds.select("host", *[(F.col(c) * (1 - damping)).alias(c) for c in ("trust", "distrust")])
    if edges.isEmpty():
        return seeds.select("host", "trust", "distrust")  # nowhere to walk
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("into"))
    shares = edges.join(out, "src").join(into, "dst").select("src", "dst", (F.col("n") / F.col("out")).alias("forth"), (F.col("n") / F.col("into")).alias("back"))
    steps = cut_lineage(shares.selectExpr("src AS at", "dst AS to", "forth", "0D AS back").unionByName(shares.selectExpr("dst AS at", "src AS to", "0D AS forth", "back")).groupBy("at", "to").agg(F.sum("forth").alias("forth"), F.sum("back").alias("back")))
    start = rank = cut_lineage(start)
    sums = [F.sum("trust"), F.sum("distrust"), F.count(F.when(F.col("trust") > 0, 1)), F.count(F.when(F.col("distrust") > 0, 1))]
    before = start.agg(*sums).first()
    while True:
        for _ in range(ROUNDS):
            moved = steps.join(rank.withColumnRenamed("host", "at"), "at").select(F.col("to").alias("host"), (F.col("trust") * F.col("forth") * damping).alias("trust"), (F.col("distrust") * F.col("back") * damping).alias("distrust"))
            rank = start.unionByName(moved).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        rank = cut_lineage(rank)
        now = rank.agg(*sums).first()  # sums only grow
        if all(now[i] - before[i] <= tolerance for i in (0, 1)) and now[2:] == before[2:]:
            return rank.select("host", *[(F.col(c) / F.lit(now[i] or 1.0)).alias(c) for i, c in enumerate(("trust", "distrust"))])
        before = now


def host_scores(pages: DataFrame, rules=RULES) -> DataFrame:
    """(host, trust, distrust) for every host with pages or links. Seeds are shares of all allowed, and of all blocked, pages."""
    counts = parsed_pages(pages, rules).groupBy("host").agg(F.count(F.when(F.col("verdict") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("verdict") == "block", 1)).alias("blocked"))
    counts = cut_lineage(counts)
    total = counts.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    seeds = counts.select("host", (F.col("allowed") / F.lit(float(total["a"] or 1))).alias("trust"), (F.col("blocked") / F.lit(float(total["b"] or 1))).alias("distrust"))
    return propagate(seeds, host_edges(pages))


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for each page."""
    scores = host_scores(pages, rules)
    out = parsed_pages(pages, rules).join(scores, "host", "left")
    method = F.when(F.col("distrust") > F.col("trust"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).drop("trust", "distrust")


def _oracle() -> str:
    return f"""
WITH RECURSIVE u AS (
  SELECT page_id, html,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*', 0) ELSE '' END AS raw_host,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*', 0) AS path FROM u),
j AS (SELECT *, CASE
  WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
  WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
  WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
  WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
  WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM p),
v AS (SELECT *, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM j),
c AS (SELECT host, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b FROM v GROUP BY host),
r0 AS (SELECT host, (1 - {DAMPING}) * a / greatest((SELECT sum(a) FROM c), 1) AS trust, (1 - {DAMPING}) * b / greatest((SELECT sum(b) FROM c), 1) AS distrust FROM c),
l AS (SELECT page_id, host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?\\s*(?:https?:)?//([^/?#"''\\s>]+)', 1), lambda x: lower(x)))) AS dst FROM v WHERE host <> ''),
e AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> dst GROUP BY src, dst),
o AS (SELECT src, sum(n) AS n FROM e GROUP BY src),
d AS (SELECT dst, sum(n) AS n FROM e GROUP BY dst),
t AS (SELECT e.src AS here, e.dst AS dest, e.n / o.n AS forth, CAST(0 AS DOUBLE) AS back FROM e JOIN o ON o.src = e.src
  UNION ALL SELECT e.dst, e.src, CAST(0 AS DOUBLE), e.n / d.n FROM e JOIN d ON d.dst = e.dst),
m AS (SELECT here, dest, sum(forth) AS forth, sum(back) AS back FROM t GROUP BY here, dest),
w(i, host, trust, distrust) AS (SELECT 0, host, CAST(trust AS DOUBLE), CAST(distrust AS DOUBLE) FROM r0
  UNION ALL SELECT w.i + 1, m.dest, sum(w.trust * m.forth) * {DAMPING}, sum(w.distrust * m.back) * {DAMPING} FROM w JOIN m ON m.here = w.host WHERE w.i < 120 GROUP BY w.i, m.dest),
r AS (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM w GROUP BY host),
k AS (SELECT greatest(sum(trust), 1e-300) AS trust, greatest(sum(distrust), 1e-300) AS distrust FROM r)
SELECT page_id, v.host, path, rule, coalesce(ruled, CASE WHEN r.distrust / k.distrust > r.trust / k.trust THEN 'block' ELSE 'allow' END) AS verdict
FROM v LEFT JOIN r ON r.host = v.host CROSS JOIN k"""


ORACLE = _oracle()
