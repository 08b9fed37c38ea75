"""URL filters: explicit host rules, else empirical-Bayes host reputation.

Outcomes: a page whose path names a labelled document (first run of digits in the path = doc_id)
counts as good when that document has quality 1 and is not toxic. Host outcomes are shrunk through
beta-binomial priors from host to registered domain (one label more than the suffix) to suffix (the
last two labels where they are one of `suffixes`, else the last);
each level's prior strength comes from the moments of its groups (Kleinman's estimator). A host is
blocked when the upper bound of its posterior good rate is below `min_good`.

Pages are summed by (host, document) before they meet the labels, so neither a hot host nor the pages
that name no document land in one task.

Defined cases: a null url or one without "://" has an empty host and path and belongs to the host
''; repeated pages count as pages of their own; repeated labels of a document count once (its
worst); an empty pages table gives an empty result; unlabelled hosts inherit their domain's prior.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import broadcast_if_small, materialize

#: Fixed values: (host, path, verdict); the longest rule that fits wins.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Public suffixes of two labels.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.sg", "com.tr", "com.tw", "gov.au", "gov.uk", "net.au", "ne.jp", "or.jp", "org.au", "org.br", "org.nz", "org.uk")
Z = 1.645
MIN_GOOD = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host or a subdomain, path prefix) and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for name, prefix, outcome in sorted(rules, key=lambda r: len(r[0] + r[1])):  # later ones are longer and win
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule, verdict = F.when(fits, name + prefix).otherwise(rule), F.when(fits, outcome).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame, n: str, k: str, mean: Column) -> DataFrame:
    """One row: the beta prior's strength (alpha + beta) from the groups' moments, 1 to 1000."""
    g = groups.where(F.col(n) > 0)
    s = F.sum(F.col(n) * F.pow(F.col(k) / F.col(n) - mean, 2))
    pq, rows = F.max(mean * (1 - mean)), F.count("*") - 1
    spread = F.sum(n) - F.sum(F.pow(F.col(n).cast("double"), 2)) / F.sum(n) - rows
    rho = F.when((pq > 0) & (spread > 0), (s - pq * rows) / (pq * spread)).otherwise(0.0)
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.0)), F.lit(0.001)), F.lit(0.5))
    return g.agg((1 / rho - 1).alias("_tau"))


def host_reputation(pages: DataFrame, labels: DataFrame, z: float = Z, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """host, n_labelled, n_good, mean and upper (posterior bound) for each host of pages(host, path)."""
    outcome = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_doc")).agg(
        F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("_good")
    )
    named = pages.select("host", F.expr("try_cast(nullif(regexp_extract(path, '[0-9]+', 0), '') AS bigint)").alias("_doc")).groupBy("host", "_doc").agg(F.count("*").alias("_pages"))
    judged = named.where(F.col("_doc").isNotNull()).join(outcome, "_doc").select("host", F.col("_pages").alias("n"), (F.col("_pages") * F.col("_good")).alias("k"))
    two = F.substring_index("host", ".", -2)
    double = two.isin(*suffixes) if suffixes else F.lit(False)
    hosts = (
        judged.unionByName(named.select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k")))
        .groupBy("host")
        .agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        .withColumn("domain", F.when(double, F.substring_index("host", ".", -3)).otherwise(two))
        .withColumn("suffix", F.when(double, two).otherwise(F.substring_index("host", ".", -1)))
    )
    hosts = materialize(hosts, "url-hosts")
    domains = materialize(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk")), "url-domains")
    suffix_sums = materialize(domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk")), "url-suffixes")
    total = suffix_sums.agg(F.sum("sn"), F.sum("sk")).first()
    prior = F.lit(((total[1] or 0) + 1) / ((total[0] or 0) + 2))

    def shrunk(groups: DataFrame, n: str, k: str, prior: str, out: str) -> tuple[DataFrame, float]:
        """groups with the mean of each, drawn to its prior, and the prior's strength."""
        tau = float(_strength(groups, n, k, F.col(prior)).first()[0] or 1.0)  # one number
        return groups.withColumn(out, (F.col(k) + tau * F.col(prior)) / (F.col(n) + tau)), tau

    def below(groups: DataFrame, above: DataFrame, keys: list[str], label: str) -> DataFrame:
        return materialize(groups.join(broadcast_if_small(above), keys), label)

    s, _ = shrunk(suffix_sums.withColumn("_m", prior), "sn", "sk", "_m", "_sm")
    d, _ = shrunk(below(domains, s.select("suffix", "_sm"), ["suffix"], "url-domain-priors"), "dn", "dk", "_sm", "_dm")
    h, tau = shrunk(below(hosts, d.select("domain", "suffix", "_dm"), ["domain", "suffix"], "url-host-priors"), "n", "k", "_dm", "mean")
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + tau + 1))
    return h.select("host", F.col("n").alias("n_labelled"), F.col("k").alias("n_good"), "mean", (F.col("mean") + z * spread).alias("upper"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, z: float = Z, min_good: float = MIN_GOOD, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, n_labelled of every page."""
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    reputation = broadcast_if_small(materialize(host_reputation(parts, labels, z, suffixes), "url-reputation"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return parts.join(reputation, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("upper") < min_good, "block").otherwise("allow")).alias("verdict"), "n_labelled",
    )


_TWO = "array_to_string(string_split(host, '.')[-2:], '.')"
_DOUBLE = f"{_TWO} IN ({', '.join(repr(x) for x in SUFFIXES)})"
ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw, coalesce(rest, '') AS rest FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM v),
o AS (SELECT doc_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good
      FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, count(good) AS n, CAST(coalesce(sum(good), 0) AS BIGINT) AS k,
             CASE WHEN @double THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE @two END AS domain, CASE WHEN @double THEN @two ELSE string_split(host, '.')[-1] END AS suffix
      FROM p LEFT JOIN o ON o.doc_id = TRY_CAST(nullif(regexp_extract(path, '[0-9]+'), '') AS BIGINT) GROUP BY host),
d AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
g AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m FROM s),
s1 AS (SELECT s.*, m FROM s, g),
st AS (SELECT 1 / least(greatest(coalesce(CASE WHEN max(m * (1 - m)) > 0 AND sum(n) - sum(n * n) / sum(n) - (count(*) - 1) > 0
        THEN (sum(n * pow(k / n - m, 2)) - max(m * (1 - m)) * (count(*) - 1)) / (max(m * (1 - m)) * (sum(n) - sum(n * n) / sum(n) - (count(*) - 1))) END, 0.0), 0.001), 0.5) - 1 AS tau FROM s1 WHERE n > 0),
s2 AS (SELECT suffix, (k + tau * m) / (n + tau) AS m FROM s1, st),
d1 AS (SELECT d.*, s2.m FROM d JOIN s2 USING (suffix)),
dt AS (SELECT 1 / least(greatest(coalesce(CASE WHEN max(m * (1 - m)) > 0 AND sum(n) - sum(n * n) / sum(n) - (count(*) - 1) > 0
        THEN (sum(n * pow(k / n - m, 2)) - max(m * (1 - m)) * (count(*) - 1)) / (max(m * (1 - m)) * (sum(n) - sum(n * n) / sum(n) - (count(*) - 1))) END, 0.0), 0.001), 0.5) - 1 AS tau FROM d1 WHERE n > 0),
d2 AS (SELECT suffix, domain, (k + tau * m) / (n + tau) AS m FROM d1, dt),
h1 AS (SELECT h.*, d2.m FROM h JOIN d2 USING (suffix, domain)),
ht AS (SELECT 1 / least(greatest(coalesce(CASE WHEN max(m * (1 - m)) > 0 AND sum(n) - sum(n * n) / sum(n) - (count(*) - 1) > 0
        THEN (sum(n * pow(k / n - m, 2)) - max(m * (1 - m)) * (count(*) - 1)) / (max(m * (1 - m)) * (sum(n) - sum(n * n) / sum(n) - (count(*) - 1))) END, 0.0), 0.001), 0.5) - 1 AS tau FROM h1 WHERE n > 0),
h2 AS (SELECT host, n, (k + tau * m) / (n + tau) AS mean, tau FROM h1, ht),
f AS (SELECT page_id, host, path,
   CASE WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/en/1') THEN 'example.org/en/1'
        WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/es/') THEN 'example.org/es/'
        WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/de/') THEN 'com/de/'
        WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/fr/') THEN 'com/fr/'
        WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/') THEN 'org/' END AS rule FROM p)
SELECT f.page_id, f.host, f.path, f.rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN mean + 1.645 * sqrt(mean * (1 - mean) / (n + tau + 1)) < 0.5 THEN 'block' ELSE 'allow' END AS verdict, n AS n_labelled
FROM f LEFT JOIN h2 USING (host)
""".replace("@double", _DOUBLE).replace("@two", _TWO)
