"""URL filters: longest-fitting rules first, then the host's reputation, in built-in functions only.

A rule is a host and a beginning of the path; it fits that host and all its
subdomains, and the longest rule that fits decides (of equally long ones the first).

Where no rule fits, the host's reputation does. Labelled page outcomes (bad: 1 or 0)
are counted by host. The rate of bad pages of a host has a beta prior whose mean is the
posterior mean of its registered domain, that of a domain the one of its public
suffix, that of a suffix the rate of all outcomes. How strongly each level shrinks
is estimated from the outcomes themselves: the overdispersion rho of the beta-binomial
by moments, strength (1 - rho) / rho. A page is blocked if the lower posterior bound of
its host's rate (mean - z * standard deviation) exceeds `most_bad`. A host without outcomes
has the prior that its domain gives.

Nothing is collected but the sums of three levels. Hosts with many pages are
broadcast to them (fewer than 50,000 by the rule that finds them), all other pages
are joined by host.

Defined results: a null URL or one without "://" has the empty host and path, and all
such pages share the reputation of the empty host; a null page_id stays; repeated rows
each give a row; without any outcome all rates are 1/2 and nothing is blocked; an empty
table gives no rows; columns beyond the named ones are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, drop_written, hot_first, materialise

#: Two-part public suffixes; every other suffix is the last label of the host. Fixed values.
TWO_PART_SUFFIXES = ["ac.uk", "co.uk", "gov.uk", "org.uk", "ac.jp", "co.jp", "ne.jp", "or.jp", "com.au", "net.au", "org.au", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.kr", "co.nz", "co.za"]

#: Pages with a greater share of bad outcomes than this, as far as the bound tells, are blocked.
MOST_BAD = 0.5
#: One-sided 95 % bound.
Z = 1.645
#: Range of the overdispersion, and its value where nothing repeats.
RHO_LEAST, RHO_MOST, RHO_UNKNOWN = 0.001, 0.5, 0.05
#: Sums of ratios are kept in whole millionths, so that their order can't matter.
MICRO = 1_000_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: str = "url") -> Column:
    return F.coalesce(F.translate(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _bare(host: Column) -> Column:
    """Without user, port and closing dots."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r"(:[0-9]*)?\.*$", "")


_ADDRESS = r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"


def with_domains(rows: DataFrame) -> DataFrame:
    """Adds domain (registered domain) and suffix of the column host; a numeric address is its own domain, without a suffix."""
    two = "|".join(s.replace(".", r"\.") for s in TWO_PART_SUFFIXES)
    pattern = rf"(?s)(?:[^.]+\.)?({two}|[^.]+)$"
    bare = _bare(F.col("host"))
    return rows.select(
        "*",
        F.when(bare.rlike(_ADDRESS), bare).otherwise(F.regexp_extract(bare, pattern, 0)).alias("domain"),
        F.when(bare.rlike(_ADDRESS), F.lit("")).otherwise(F.regexp_extract(bare, pattern, 1)).alias("suffix"),
    )


def _mean(n: Column, bad: Column, parent: Column, strength: float) -> Column:
    return (strength * parent + bad) / (strength + n)


def _strength(level: DataFrame) -> float:
    """(1 - rho) / rho of a level(n, bad, parent): Pearson's chi-square of the groups is 1 + (n - 1) rho each, in expectation."""
    p, n = F.col("parent"), F.col("n").cast("double")
    off = F.col("bad") - n * p
    chi = F.round(MICRO * (off * off / (n * p * (1 - p)))).cast("long")
    total, groups, more = level.where("n > 0").agg(F.sum(chi), F.count(F.lit(1)), F.sum(F.col("n") - 1)).first()
    rho = RHO_UNKNOWN if not more else (total - MICRO * groups) / (MICRO * more)
    rho = min(max(rho, RHO_LEAST), RHO_MOST)
    return (1 - rho) / rho


def reputations(hosts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Of each row of hosts(host, ...): domain, suffix, n_labelled, bad_mean, bad_bound by outcomes(host, bad)."""
    known = outcomes.where("bad is not null").select(F.coalesce("host", F.lit("")).alias("host"), F.col("bad").cast("long").alias("bad"))
    by_host = with_domains(known.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad")))
    by_host = materialise(by_host, "host-outcomes")
    counts = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_domain = by_host.groupBy("suffix", "domain").agg(*counts)
    by_suffix = by_host.groupBy("suffix").agg(*counts)
    n, bad = by_host.agg(*counts).first()
    rate = ((bad or 0) + 1) / ((n or 0) + 2)

    by_suffix = by_suffix.withColumn("parent", F.lit(rate))
    firm = _strength(by_suffix)
    suffixes = materialise(by_suffix.select("suffix", _mean(F.col("n"), F.col("bad"), F.col("parent"), firm).alias("parent")), "suffix-rates")
    by_domain = by_domain.join(suffixes, "suffix")
    firm = _strength(by_domain)
    domains = materialise(by_domain.select("domain", "suffix", _mean(F.col("n"), F.col("bad"), F.col("parent"), firm).alias("own")), "domain-rates")
    firm = _strength(by_host.join(domains.withColumnRenamed("own", "parent"), ["domain", "suffix"]))

    found = with_domains(hosts).join(by_host.select("host", "n", "bad"), "host", "left").join(domains, ["domain", "suffix"], "left").join(suffixes, "suffix", "left")
    # Without outcomes a posterior mean is the prior's: that of the suffix, or of all.
    found = found.withColumns({"n": F.coalesce("n", F.lit(0)), "bad": F.coalesce("bad", F.lit(0)), "above": F.coalesce("own", "parent", F.lit(rate))})
    mean = _mean(F.col("n"), F.col("bad"), F.col("above"), firm)
    found = found.select(*hosts.columns, "domain", "suffix", F.col("n").alias("n_labelled"), mean.alias("bad_mean"), (F.col("n") + firm + 1).alias("weight"))
    bound = F.col("bad_mean") - Z * F.sqrt(F.col("bad_mean") * (1 - F.col("bad_mean")) / F.col("weight"))
    found = materialise(found.select(*hosts.columns, "domain", "suffix", "n_labelled", F.round("bad_mean", 6).alias("bad_mean"), F.round(bound, 6).alias("bad_bound")), "reputations")
    drop_written(by_host, suffixes, domains)
    return found


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, most_bad: float = MOST_BAD, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, domain, suffix, n_labelled, bad_mean, bad_bound."""
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    state = reputations(rows.groupBy("host").agg(F.count(F.lit(1)).alias("size")), outcomes)
    judged = hot_first(rows, state, "host", "size").withColumn("_found", matching_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("bad_bound") > most_bad, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("_found.rule").alias("rule"), F.coalesce("_found.verdict", own).alias("verdict"), "domain", "suffix", "n_labelled", "bad_mean", "bad_bound")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes (host, bad) of pages whose document has a label.

    A page is that of the document whose number ends its path. A document is bad if any
    of its rows of labels calls it toxic or of low quality; without a label of either
    kind it gives no outcome.
    """
    bad = F.when(F.col("toxic").isNull() & F.col("quality").isNull(), None).otherwise(F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False)))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), bad.cast("int").alias("bad")).where("doc_id is not null and bad is not null")
    number = F.regexp_extract(path_of(), "([0-9]{1,18})[^0-9]*$", 1)
    rows = pages.select(host_of().alias("host"), F.when(number != "", number).cast("long").alias("doc_id")).where("doc_id is not null")
    return rows.join(known.groupBy("doc_id").agg(F.max("bad").alias("bad")), "doc_id").select("host", "bad")


_TWO = "|".join(s.replace(".", r"\.") for s in TWO_PART_SUFFIXES)

ORACLE_SQL = rf"""
WITH p AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}') ELSE '' END AS host, CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path FROM pages),
l AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL) GROUP BY doc_id),
o AS (SELECT host, count(*) AS n, sum(bad)::BIGINT AS bad FROM (SELECT host, TRY_CAST(regexp_extract(path, '([0-9]{{1,18}})[^0-9]*$', 1) AS BIGINT) AS doc_id FROM p) JOIN l USING (doc_id) GROUP BY host),
a AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', '', 's'), '(:[0-9]*)?\.*$', '') AS bare FROM (SELECT DISTINCT host FROM p)),
h AS (SELECT host, CASE WHEN regexp_matches(bare, '^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$') THEN bare ELSE regexp_extract(bare, '(?:[^.]+\.)?({_TWO}|[^.]+)$', 0) END AS domain, CASE WHEN regexp_matches(bare, '^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$') THEN '' ELSE regexp_extract(bare, '(?:[^.]+\.)?({_TWO}|[^.]+)$', 1) END AS suffix, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad FROM a LEFT JOIN o USING (host)),
g AS (SELECT (coalesce(sum(bad), 0) + 1)::DOUBLE / (coalesce(sum(n), 0) + 2) AS rate FROM h),
s AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad, any_value(rate) AS p FROM h, g GROUP BY suffix),
ks AS (SELECT (1 - r) / r AS k FROM (SELECT least(greatest(CASE WHEN coalesce(sum(n - 1), 0) = 0 THEN 0.05::DOUBLE ELSE (sum(round(1000000 * ((bad - n * p) * (bad - n * p) / (n * p * (1 - p))))::BIGINT) - 1000000 * count(*))::DOUBLE / (1000000 * sum(n - 1))::DOUBLE END, 0.001::DOUBLE), 0.5::DOUBLE) AS r FROM s WHERE n > 0)),
sm AS (SELECT suffix, (k * p + bad) / (k + n) AS mean FROM s, ks),
d AS (SELECT h.domain, h.suffix, sum(h.n)::BIGINT AS n, sum(h.bad)::BIGINT AS bad, any_value(mean) AS p FROM h JOIN sm USING (suffix) GROUP BY h.domain, h.suffix),
kd AS (SELECT (1 - r) / r AS k FROM (SELECT least(greatest(CASE WHEN coalesce(sum(n - 1), 0) = 0 THEN 0.05::DOUBLE ELSE (sum(round(1000000 * ((bad - n * p) * (bad - n * p) / (n * p * (1 - p))))::BIGINT) - 1000000 * count(*))::DOUBLE / (1000000 * sum(n - 1))::DOUBLE END, 0.001::DOUBLE), 0.5::DOUBLE) AS r FROM d WHERE n > 0)),
dm AS (SELECT domain, suffix, (k * p + bad) / (k + n) AS p FROM d, kd),
x AS (SELECT h.*, p FROM h JOIN dm USING (domain, suffix)),
kh AS (SELECT (1 - r) / r AS k FROM (SELECT least(greatest(CASE WHEN coalesce(sum(n - 1), 0) = 0 THEN 0.05::DOUBLE ELSE (sum(round(1000000 * ((bad - n * p) * (bad - n * p) / (n * p * (1 - p))))::BIGINT) - 1000000 * count(*))::DOUBLE / (1000000 * sum(n - 1))::DOUBLE END, 0.001::DOUBLE), 0.5::DOUBLE) AS r FROM x WHERE n > 0)),
m AS (SELECT host, domain, suffix, n, (k * p + bad) / (k + n) AS mean, n + k + 1 AS weight FROM x, kh),
b AS (SELECT *, mean - 1.645::DOUBLE * sqrt(mean * (1 - mean) / weight) AS bound FROM m),
r AS (SELECT p.*, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p)
SELECT page_id, r.host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN round(bound, 6) > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
    domain, suffix, n AS n_labelled, round(mean, 6) AS bad_mean, round(bound, 6) AS bad_bound FROM r JOIN b ON b.host = r.host
"""
