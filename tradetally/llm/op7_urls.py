"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes are summed by host, registered domain and suffix. Each
level's beta-binomial prior has its parent's posterior mean and a strength
that the method of moments estimates from the spread of the level's own
rates; so a host with few labelled pages is shrunk to its domain, a domain to
its suffix, and a suffix to all pages. A host is blocked if the lower bound of
its posterior bad rate exceeds a threshold. Explicit rules go before that.

A suffix is the last label of a host name; the last two below a country's code
if the first of them names a kind of registrant there (``co.uk``), and below a
platform whose customers have names of their own (``PLATFORMS``). The registered
domain is the suffix with the label before it. For both, a user, a port and dots at
the end of the host do not count. A numeric address is its own domain; all addresses
share one suffix.

Defined results: a null url, or one without ``://``, has an empty host and
path, fits no rule and is allowed; a page that is labelled more than once counts
as bad if any of its labels is; without labels nothing is blocked by the
method; equal rows are judged alike and all returned; a null page_id has no
label; a host that is a suffix itself is its own domain; urls of any length are
read whole; further columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradetally.llm.common import stored, table

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Posterior deviations below the mean, and the bad rate that the bound must exceed.
Z = 1.645
BAD_RATE = 0.5
#: Limits of a prior's strength, in pages.
STRENGTH = (4.0, 1000.0)
# fixed values: labels that name kinds of registrants below country codes
KINDS = ("ac", "co", "com", "edu", "gen", "go", "gob", "gouv", "gov", "govt", "gv", "ltd", "mil", "ne", "net", "nhs", "nic", "nom", "or",
         "org", "plc", "sch", "school")
#: Names below which customers of a platform have their own.
PLATFORMS = ("blogspot.com", "github.io", "wordpress.com")
ADDRESS = "[address]"
_ADDRESS = r"^([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|\[.*)$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    fits = [((host == F.lit(h)) | host.endswith("." + h)) & path.startswith(p)
            for _, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))]
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    name = F.coalesce(*(F.when(f, F.lit(h + p)) for f, (_, h, p) in zip(fits, order)), F.lit(None).cast("string"))
    verdict = F.coalesce(*(F.when(f, F.lit(v)) for f, (v, _, _) in zip(fits, order)), F.lit(None).cast("string"))
    return name, verdict


def domain_of(host: Column, platforms=PLATFORMS) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), r"\.+$", "")
    parts = F.split(name, r"\.")
    size, last, before = F.size(parts), F.get(parts, F.size(parts) - 1), F.get(parts, F.size(parts) - 2)
    two = F.concat_ws(".", before, last)
    of_two = F.coalesce(last.rlike("^[a-z][a-z]$") & before.isin(*KINDS), F.lit(False)) | two.isin(*platforms)
    n = F.when(of_two, 2).otherwise(1)

    def end(labels: Column) -> Column:
        return F.array_join(F.slice(parts, size - labels + 1, labels), ".")

    address = name.rlike(_ADDRESS)
    return (F.when(address, name).otherwise(end(F.least(n + 1, size))),
            F.when(address, F.lit(ADDRESS)).otherwise(end(F.least(n, size))))


def _strength(level: DataFrame) -> DataFrame:
    """One row (s): the prior strength of a level by moments of (n, k)."""
    t = level.where("n > 0").agg(
        F.count("*").alias("u"), F.sum("n").alias("sn"), F.sum("k").alias("sk"),
        F.sum(F.col("n") * F.col("n")).alias("snn"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("skk"))
    p = F.col("sk") / F.col("sn")
    within = p * (1 - p)
    spread = F.col("skk") - F.col("sn") * p * p - (F.col("u") - 1) * within
    scale = (F.col("sn") - F.col("snn") / F.col("sn") - (F.col("u") - 1)) * within
    rho = F.when(scale > 0, spread / scale)
    s = F.when(rho > 0, F.least(F.greatest((1 - rho) / rho, F.lit(STRENGTH[0])), F.lit(STRENGTH[1])))
    return t.select(F.coalesce(s, F.lit(STRENGTH[1])).alias("s"))


def reputations(spark: SparkSession, pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, labelled, bad, mean, bound) of every host of ``pages`` (page_id, host);
    ``labels`` is (page_id, bad 0/1)."""
    bad = labels.where(F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    per_host = pages.where("host != ''").join(bad, "page_id", "left").groupBy("host").agg(
        F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("k"))
    domain, suffix = domain_of(F.col("host"))
    hosts = stored(spark, per_host.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    domains = stored(spark, hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))

    # one row each: the rate of all pages and the strengths of the levels
    everything = suffixes.agg(F.coalesce((F.sum("k") + 1) / (F.sum("n") + 2), F.lit(0.5)).alias("m")).first()
    of_suffix, of_domain, of_host = (_strength(x).first()["s"] for x in (suffixes, domains, hosts))

    def mean(m: Column, s: float) -> Column:
        return (F.col("k") + F.lit(s) * m) / (F.col("n") + F.lit(s))

    top = suffixes.select("suffix", mean(F.lit(everything["m"]), of_suffix).alias("m1"))
    middle = stored(spark, domains.join(top, "suffix").select(
        "domain", "suffix", mean(F.col("m1"), of_domain).alias("m2")), "domains")
    m, size = F.col("mean"), F.col("n") + F.lit(of_host)
    return hosts.join(middle, ["domain", "suffix"]).withColumn("mean", mean(F.col("m2"), of_host)).select(
        "host", F.col("n").alias("labelled"), F.col("k").alias("bad"), "mean",
        (m - F.lit(Z) * F.sqrt(m * (1 - m) / (size + 1))).alias("bound"))


def judge(spark: SparkSession, pages: DataFrame, labels: DataFrame, rules=RULES, bad_rate: float = BAD_RATE) -> DataFrame:
    """(page_id, host, path, rule, verdict, bound) of every row of ``pages`` (page_id, url)."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = stored(spark, reputations(spark, rows, labels).select("host", "bound"), "reputations")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("bound") > bad_rate, F.lit("block")).otherwise(F.lit("allow"))
    # pages without a host do not meet in the join
    named = rows.where("host != ''").join(known, "host", "left")
    nameless = rows.where("host = ''").withColumn("bound", F.lit(None).cast("double"))
    return named.unionByName(nameless).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), "bound")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled page is bad if it is of low quality or toxic."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"),
        F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(
            F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0).alias("bad"))
    return judge(spark, table(spark, sf_dir, "pages"), labels).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    order = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    kinds, platforms = (", ".join(f"'{x}'" for x in xs) for xs in (KINDS, PLATFORMS))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", v, h + p) for v, h, p in order]
    rule = " ".join(f"WHEN {f} THEN '{r}'" for f, _, r in fits)
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, v, _ in fits)

    def strength(level: str) -> str:
        return f"""SELECT CASE WHEN scale > 0 AND spread / scale > 0
            THEN least(greatest((1 - spread / scale) / (spread / scale), {STRENGTH[0]}), {STRENGTH[1]})
            ELSE {STRENGTH[1]} END AS s
          FROM (SELECT skk - sn * p * p - (u - 1) * p * (1 - p) AS spread,
                       (sn - snn / sn - (u - 1)) * p * (1 - p) AS scale
                FROM (SELECT count(*) AS u, sum(n) AS sn, sum(n * n) AS snn, sum(k * k / n) AS skk,
                             sum(k) / sum(n) AS p FROM {level} WHERE n > 0))"""

    return f"""
WITH u AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
l AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels
      WHERE toxic IS NOT NULL OR quality IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k,
       regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.+$', '') AS name
       FROM u LEFT JOIN l ON page_id = doc_id WHERE host <> '' GROUP BY host),
h1 AS (SELECT *, string_split(name, '.') AS parts, regexp_matches(name, '{_ADDRESS}') AS address FROM h0),
h2 AS (SELECT *, CASE WHEN len(parts) > 1 AND (regexp_matches(parts[-1], '^[a-z][a-z]$') AND parts[-2] IN ({kinds})
       OR parts[-2] || '.' || parts[-1] IN ({platforms})) THEN 2 ELSE 1 END AS labels FROM h1),
h AS (SELECT host, n, k, CASE WHEN address THEN '{ADDRESS}' ELSE array_to_string(parts[-labels:], '.') END AS suffix,
       CASE WHEN address THEN name ELSE array_to_string(parts[-(labels + 1):], '.') END AS domain FROM h2),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
m0 AS (SELECT coalesce((sum(k) + 1) / (sum(n) + 2), 0.5) AS m FROM s),
s1 AS ({strength("s")}), s2 AS ({strength("d")}), s3 AS ({strength("h")}),
p1 AS (SELECT suffix, (k + s1.s * m) / (n + s1.s) AS m1 FROM s, m0, s1),
p2 AS (SELECT domain, d.suffix, (k + s2.s * m1) / (n + s2.s) AS m2 FROM d JOIN p1 USING (suffix), s2),
p3 AS (SELECT host, (k + s3.s * m2) / (n + s3.s) AS m3, n + s3.s AS size FROM h JOIN p2 USING (domain, suffix), s3),
r AS (SELECT host, m3 - {Z} * sqrt(m3 * (1 - m3) / (size + 1)) AS bound FROM p3)
SELECT page_id, u.host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN bound > {BAD_RATE} THEN 'block' ELSE 'allow' END AS verdict
FROM (SELECT u.*, bound FROM u LEFT JOIN r USING (host)) u""".strip()


ORACLE_SQL = _sql()
