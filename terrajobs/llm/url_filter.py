"""URL filtering by explicit rules and by an empirical-Bayes reputation of hosts.

Labelled pages of a host are a beta-binomial draw whose prior is the host's registered domain, whose prior is its public
suffix, whose prior is all pages. How strongly a level shrinks towards its parent is estimated, by moments, from how much the
level's groups differ beyond chance. A page is blocked where the lower posterior bound of its host's bad share is
above a threshold: where the host is bad beyond doubt, and not where little is known of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrajobs.functions.storage import materialize
from terrajobs.llm.hosts import domain_of, host_of, path_of, suffix_of

#: The rules of the query, as (verdict, rule); a rule is a host and the start of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A page goes where its host's bad share is above this with the confidence of the bound (standard normal deviate).
MOST_BAD = 0.5
DEVIATE = 1.645
#: Limits of a prior's strength, in labelled pages.
STRENGTH = (1.0, 1000.0)


def matching_rule(host: str, path: str, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does.

    A rule fits its host and all subdomains where the path starts with the rule's. Of rules of equal length the lesser.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, _, start = text.partition("/")
        fits = ((F.col(host) == name) | F.col(host).endswith("." + name)) & F.col(path).startswith("/" + start)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _strength(level: DataFrame, mean: str) -> float:
    """Prior strength of a level's groups (bad, n) around their parents' mean, by moments. One row to the driver."""
    m = F.greatest(F.least(F.col(mean), F.lit(1 - 1e-6)), F.lit(1e-6))
    excess = F.col("n") * F.pow(F.col("bad") / F.col("n") - m, 2) / (m * (1 - m))
    row = level.where("n > 0").agg(F.sum(excess).alias("s"), F.count("*").alias("k"), F.sum(F.col("n") - 1).alias("d")).first()
    if not row["k"] or not row["d"]:
        return STRENGTH[1]
    rho = (row["s"] - row["k"]) / row["d"]
    return min(STRENGTH[1], max(STRENGTH[0], 1 / rho - 1)) if rho > 0 else STRENGTH[1]


def host_reputation(pages: DataFrame, outcomes: DataFrame, deviate: float = DEVIATE) -> DataFrame:
    """``host, domain, suffix, n_labelled, bad_mean, bad_bound`` of every host of ``pages`` (page_id, host).

    ``outcomes`` (page_id, bad) has the labelled pages, 1 for bad. Hosts without labels have their prior. Pages
    shrink to a row per host before anything is joined.
    """
    said = outcomes.where(F.col("page_id").isNotNull() & F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").cast("double").alias("bad"))
    hosts = pages.join(said, "page_id", "left").groupBy("host").agg(F.sum("bad").alias("bad"), F.count("bad").cast("double").alias("n")).fillna(0.0, ["bad"])
    hosts = materialize(hosts.withColumns({"domain": domain_of("host"), "suffix": suffix_of("host")}), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    total = suffixes.agg(F.sum("bad"), F.sum("n")).first()
    everything = ((total[0] or 0.0) + 1) / ((total[1] or 0.0) + 2)

    def shrunk(level: DataFrame, parent: Column | str, name: str) -> DataFrame:
        k = _strength(level.withColumn("_m", parent if isinstance(parent, Column) else F.col(parent)), "_m")
        mean = parent if isinstance(parent, Column) else F.col(parent)
        return level.withColumns({f"{name}_good": F.col("n") - F.col("bad") + k * (1 - mean), f"{name}_bad": F.col("bad") + k * mean})

    def mean_of(name: str) -> Column:
        return F.col(f"{name}_bad") / (F.col(f"{name}_good") + F.col(f"{name}_bad"))

    by_suffix = shrunk(suffixes, F.lit(everything), "s").select("suffix", mean_of("s").alias("suffix_mean"))
    by_domain = shrunk(domains.join(by_suffix, "suffix"), "suffix_mean", "d").select("domain", "suffix", mean_of("d").alias("domain_mean"))
    by_host = shrunk(hosts.join(by_domain, ["domain", "suffix"]), "domain_mean", "h")
    a, b = F.col("h_bad"), F.col("h_good")
    spread = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return by_host.select("host", "domain", "suffix", F.col("n").cast("long").alias("n_labelled"), mean_of("h").alias("bad_mean"), (mean_of("h") - deviate * spread).alias("bad_bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, most_bad: float = MOST_BAD) -> DataFrame:
    """``page_id, host, path, rule, verdict, n_labelled, bad_mean, bad_bound`` of every row of ``pages`` (page_id, url).

    Null urls and those without ``://`` have empty host and path and are judged by the reputation of the empty host. Repeated
    rows and null page_ids come through each. No rows give no rows. A host with a third of all pages is one row where
    it is aggregated, and AQE splits it where its pages meet that row.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of("url").alias("host"), path_of("url").alias("path"))
    known = host_reputation(rows.select("page_id", "host"), outcomes)
    rule, verdict = matching_rule("host", "path", rules)
    judged = rows.join(known.drop("domain", "suffix"), "host").withColumns({"rule": rule, "ruled": verdict})
    own = F.when(F.col("bad_bound") > most_bad, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "n_labelled", "bad_mean", "bad_bound")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``page_id, bad``: pages whose document is labelled; bad is low quality or toxic. A page shows the document whose
    doc_id is the first number in its path."""
    shown = pages.select("page_id", F.regexp_extract(path_of("url"), r"/([0-9]{1,18})(?:[^0-9]|$)", 1).alias("number")).where("number <> ''")
    shown = shown.select("page_id", F.col("number").cast("long").alias("doc_id"))
    marks = labels.select("doc_id", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0).alias("bad"))
    return shown.join(marks, "doc_id").select("page_id", "bad")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict, with the reputation of its host."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    out = judge(pages, labelled_pages(pages, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.withColumns({"bad_mean": F.round("bad_mean", 4), "bad_bound": F.round("bad_bound", 4)})


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), said AS (
  SELECT page_id, max(bad) AS bad FROM (
    SELECT p.page_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS bad
    FROM p JOIN labels l ON l.doc_id = TRY_CAST(nullif(regexp_extract(path, '/([0-9]{1,18})(?:[^0-9]|$)', 1), '') AS BIGINT)) GROUP BY 1
), hosts AS (
  SELECT host, coalesce(sum(bad), 0) AS bad, count(bad)::DOUBLE AS n FROM p LEFT JOIN said USING (page_id) GROUP BY 1
), named AS (
  SELECT *, regexp_extract(host, '[^.]*$', 0) AS suffix,
         coalesce(nullif(regexp_extract(host, '[^.]+\.[^.]+$', 0), ''), host) AS domain FROM hosts
), domains AS (SELECT domain, suffix, sum(bad) AS bad, sum(n) AS n FROM named GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM domains GROUP BY 1),
total AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS m FROM suffixes),
s0 AS (SELECT s.*, greatest(least(t.m, 1 - 1e-6), 1e-6) AS g, t.m FROM suffixes s, total t),
ks AS (SELECT (sum(n * pow(bad / n - g, 2) / (g * (1 - g))) - count(*)) / nullif(sum(n - 1), 0) AS rho FROM s0 WHERE n > 0),
s1 AS (SELECT suffix, (bad + k * m) / ((n - bad + k * (1 - m)) + (bad + k * m)) AS m
       FROM s0, (SELECT CASE WHEN rho > 0 THEN least(1000.0::DOUBLE, greatest(1.0::DOUBLE, 1 / rho - 1)) ELSE 1000.0::DOUBLE END AS k FROM ks)),
d0 AS (SELECT d.*, s1.m, greatest(least(s1.m, 1 - 1e-6), 1e-6) AS g FROM domains d JOIN s1 USING (suffix)),
kd AS (SELECT (sum(n * pow(bad / n - g, 2) / (g * (1 - g))) - count(*)) / nullif(sum(n - 1), 0) AS rho FROM d0 WHERE n > 0),
d1 AS (SELECT domain, suffix, (bad + k * m) / ((n - bad + k * (1 - m)) + (bad + k * m)) AS m
       FROM d0, (SELECT CASE WHEN rho > 0 THEN least(1000.0::DOUBLE, greatest(1.0::DOUBLE, 1 / rho - 1)) ELSE 1000.0::DOUBLE END AS k FROM kd)),
h0 AS (SELECT h.*, d1.m, greatest(least(d1.m, 1 - 1e-6), 1e-6) AS g FROM named h JOIN d1 USING (domain, suffix)),
kh AS (SELECT (sum(n * pow(bad / n - g, 2) / (g * (1 - g))) - count(*)) / nullif(sum(n - 1), 0) AS rho FROM h0 WHERE n > 0),
h1 AS (SELECT host, n, bad + k * m AS a, n - bad + k * (1 - m) AS b
       FROM h0, (SELECT CASE WHEN rho > 0 THEN least(1000.0::DOUBLE, greatest(1.0::DOUBLE, 1 / rho - 1)) ELSE 1000.0::DOUBLE END AS k FROM kh)),
h2 AS (SELECT host, n::BIGINT AS n_labelled, a / (b + a) AS bad_mean, a / (b + a) - 1.645::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bad_bound FROM h1),
ruled AS (
  SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM p JOIN h2 USING (host)
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN bad_bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
       n_labelled, round(bad_mean, 4) AS bad_mean, round(bad_bound, 4) AS bad_bound
FROM ruled
"""
