"""Empirical-Bayes host reputation for URL filtering (operator 5).

Labelled page outcomes are counted by host.  Going from suffix to registered
domain to host, each level's good rate is shrunk towards its parent's posterior
mean by a beta-binomial prior; the prior's strength comes from the moments of
that level over the whole table.  A page passes if the lower posterior bound of
its host's good rate is high enough.  Explicit rules come first.

Everything is DataFrame expressions.  The small tables by host, domain and
suffix are written once, so Spark knows their sizes and either broadcasts them
or shuffles and splits a hot host.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.storage import materialize

Z = 1.645
LEAST_GOOD = 0.5
#: Bounds of the intra-class correlation, so of the prior's strength 1 / rho - 1.
LEAST_RHO, MOST_RHO = 0.002, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Labels that make a public suffix together with a country's two letters.
SECOND_LABELS = ("ac", "co", "com", "edu", "gob", "gov", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
#: Rules (host, path prefix, verdict) of the registered query.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for null or none."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))


def host(url: Column) -> Column:
    """Up to the first ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def suffix(host: Column) -> Column:
    """The last label, or the last two where a country's second level is known to be public."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.rlike(rf"^(?:{'|'.join(SECOND_LABELS)})\.[a-z]{{2}}$"), two).otherwise(F.substring_index(host, ".", -1))


def placed(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """``hosts`` (host and more) with domain and suffix: the longest of ``suffixes`` (suffix), else by the rule.

    A public list of suffixes, one a row without wildcards, goes in as it is.
    A host's ends of up to six labels are looked up by an equi-join.
    """
    found = hosts.withColumn("suffix", suffix(F.col("host")))
    if suffixes is not None:
        labels = F.size(F.split("host", r"\."))
        ends = hosts.select("host", F.explode(F.sequence(F.lit(1), F.least(labels, F.lit(6)))).alias("_n")).withColumn("_end", F.expr("substring_index(host, '.', -_n)"))
        known = ends.join(suffixes.select(F.col("suffix").alias("_end")).distinct(), "_end").groupBy("host").agg(F.max_by("_end", "_n").alias("_known"))
        found = found.join(known, "host", "left").withColumn("suffix", F.coalesce("_known", "suffix")).drop("_known")
    more = F.size(F.split("suffix", r"\.")) + 1
    return found.withColumn("_n", -more).withColumn("domain", F.expr("substring_index(host, '.', _n)")).drop("_n")


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule's text (host and path) and verdict; null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for at, start, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0], r[1])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        text = F.when(fits, F.lit(at + start)).otherwise(text)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return text, verdict


def _strength(groups: DataFrame) -> float:
    """Prior strength from the spread of k / n about the parents' means m, by moments."""
    expected = F.greatest(F.col("m") * (1 - F.col("m")), F.lit(1e-6))
    spread = F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("m"), 2) / expected)
    s = groups.where("n > 0").agg(spread.alias("spread"), F.count(F.lit(1)).alias("groups"), F.sum(F.col("n") - 1).alias("free")).first()
    rho = (s.spread - s.groups) / s.free if s.free else MOST_RHO
    return 1 / min(max(rho, LEAST_RHO), MOST_RHO) - 1


def reputation(pages: DataFrame, outcomes: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """host, n, k, alpha, beta for every host of ``pages`` (page_id, url).

    ``outcomes`` has page_id and good (boolean); pages without one, and nulls,
    only name their host.  A page labelled twice is good if every label is.
    Without any outcome all hosts share a uniform prior.
    """
    marks = outcomes.where("page_id is not null and good is not null").groupBy("page_id").agg(F.min(F.col("good").cast("int")).alias("good"))
    marked = pages.select("page_id", host(F.col("url")).alias("host")).join(marks, "page_id", "left")
    by_host = marked.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("k"))
    hosts = materialize(placed(by_host, suffixes), "url-hosts")
    by_domain = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = materialize(by_domain, "url-domains")
    total = domains.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    mean = (total.k + 1) / (total.n + 2) if total.n else 0.5

    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("m", F.lit(mean))
    suffixes = materialize(_shrunk(suffixes, _strength(suffixes)).select("suffix", F.col("mean").alias("m")), "url-suffixes")
    below = materialize(domains.join(suffixes, "suffix"), "url-domains")
    below = materialize(_shrunk(below, _strength(below)).select("domain", F.col("mean").alias("m")), "url-domains")
    under = materialize(hosts.join(below, "domain"), "url-hosts")
    shrunk = _shrunk(under, _strength(under))
    return materialize(shrunk.select("host", "n", "k", "alpha", "beta"), "url-reputation")


def _shrunk(groups: DataFrame, strength: float) -> DataFrame:
    posterior = groups.withColumn("alpha", F.col("m") * strength + F.col("k")).withColumn("beta", (1 - F.col("m")) * strength + F.col("n") - F.col("k"))
    return posterior.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def lower_bound(alpha: Column, beta: Column, z: float = Z) -> Column:
    """Normal lower bound of a beta posterior."""
    total = alpha + beta
    return alpha / total - z * F.sqrt(alpha * beta / (total * total * (total + 1)))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, least_good: float = LEAST_GOOD, suffixes: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every page; a null or malformed url has an empty host, which is a host like others."""
    known = reputation(pages, outcomes, suffixes).select(F.col("host").alias("_host"), "alpha", "beta")
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    judged = parts.join(known, F.col("host") == F.col("_host"), "left")
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(lower_bound(F.col("alpha"), F.col("beta")) >= least_good, F.lit("allow")).otherwise(F.lit("block"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, method).alias("verdict"))


def outcomes_from_labels(labels: DataFrame) -> DataFrame:
    """Page outcomes by the labels of the same id: good if of quality and not toxic."""
    return labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).alias("good"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, outcomes_from_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
o AS (SELECT doc_id AS page_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, count(good) AS n, coalesce(sum(good), 0) AS k,
      CASE WHEN regexp_full_match(array_to_string(string_split(host, '.')[-2:], '.'), '(ac|co|com|edu|gob|gov|ltd|mil|ne|net|nom|or|org|plc|sch)\.[a-z][a-z]') THEN 1 ELSE 0 END AS two, string_split(host, '.') AS labels
      FROM p LEFT JOIN o USING (page_id) GROUP BY host),
hd AS (SELECT host, n, k, array_to_string(labels[-(2 + two):], '.') AS domain, array_to_string(labels[-(1 + two):], '.') AS suffix FROM h),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hd GROUP BY domain, suffix),
t AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(k) + 1.0::DOUBLE) / (sum(n) + 2) ELSE 0.5 END AS mean FROM d),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(t.mean) AS m FROM d, t GROUP BY suffix),
rs AS (SELECT 1 / least(greatest(coalesce((sum(n * pow(k / n::DOUBLE - m, 2) / greatest(m * (1 - m), 1e-6)) - count(*)) / nullif(sum(n - 1), 0), 0.5), 0.002), 0.5) - 1 AS strength FROM s WHERE n > 0),
sp AS (SELECT suffix, (m * strength + k) / (m * strength + k + (1 - m) * strength + n - k) AS m FROM s, rs),
dm AS (SELECT domain, n, k, m FROM d JOIN sp USING (suffix)),
rd AS (SELECT 1 / least(greatest(coalesce((sum(n * pow(k / n::DOUBLE - m, 2) / greatest(m * (1 - m), 1e-6)) - count(*)) / nullif(sum(n - 1), 0), 0.5), 0.002), 0.5) - 1 AS strength FROM dm WHERE n > 0),
dp AS (SELECT domain, (m * strength + k) / (m * strength + k + (1 - m) * strength + n - k) AS m FROM dm, rd),
hm AS (SELECT host, n, k, m FROM hd JOIN dp USING (domain)),
rh AS (SELECT 1 / least(greatest(coalesce((sum(n * pow(k / n::DOUBLE - m, 2) / greatest(m * (1 - m), 1e-6)) - count(*)) / nullif(sum(n - 1), 0), 0.5), 0.002), 0.5) - 1 AS strength FROM hm WHERE n > 0),
hp AS (SELECT host, m * strength + k AS a, (1 - m) * strength + n - k AS b FROM hm, rh),
v AS (SELECT host, CASE WHEN a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) >= 0.5 THEN 'allow' ELSE 'block' END AS method FROM hp)
SELECT page_id, p.host AS host, path,
  CASE WHEN (p.host = 'www.example.com' OR p.host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
       WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
       WHEN (p.host = 'net' OR p.host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
       WHEN (p.host = 'net' OR p.host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
       WHEN (p.host = 'com' OR p.host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule,
  CASE WHEN (p.host = 'www.example.com' OR p.host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'allow'
       WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'block'
       WHEN (p.host = 'net' OR p.host LIKE '%.net') AND (path LIKE '/es/%' OR path LIKE '/fr/%') THEN 'block'
       WHEN (p.host = 'com' OR p.host LIKE '%.com') AND path LIKE '/%' THEN 'allow' ELSE method END AS verdict
FROM p JOIN v ON p.host = v.host
"""
