"""URL filters: fixed rules first, then the reputation of the host by empirical Bayes.

Labelled pages say how many of a host's pages are bad. Hosts are shrunk towards their registered domain, domains towards
their suffix, suffixes towards all pages: a level's posterior is a beta distribution whose prior has the parent's
posterior mean and a strength that the level's own spread tells (beta-binomial moments). A host without labels has its
parent's posterior. A page is blocked if the lower bound of its host's bad rate is over a limit.

Cases: a null url or one without :// has an empty host and path, is judged by the reputation of all pages, and matches no
rule; hosts are compared byte for byte after A-Z are lower-cased, ports and user names included; a host of one label is
its own domain and suffix; pages with a null outcome don't count; with no labelled page nothing is blocked; repeated rows
are judged each; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfield.llm.shared import join_counted, written

#: Block if posterior mean - Z deviations is over LIMIT. Strengths stay within bounds, so that no level is ignored.
LIMIT, Z, WEAKEST, STRONGEST = 0.3, 1.645, 2.0, 1000.0
#: Suffixes of two labels; a parameter.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "co.jp", "co.nz", "com.br", "co.za")


def url_host(url: Column | str) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column, two_labels: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """The last label, or the last two if they are a known suffix."""
    return F.when(F.substring_index(host, ".", -2).isin(*two_labels), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, two_labels: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """The suffix and one label before it."""
    return F.when(F.substring_index(host, ".", -2).isin(*two_labels), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest of the rules (verdict, host/path) that fits, as a struct(verdict, rule); null if none. The list is part of the plan."""
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string,host:string,path:string>")
    table = [F.struct(F.lit(len(r)).alias("size"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(r.partition("/")[0]).alias("host"), F.lit("/" + r.partition("/")[2]).alias("path")) for v, r in rules]
    fits = F.filter(F.array(*table), lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"]))
    return F.array_max(fits)


def _shrunk(level: DataFrame) -> DataFrame:
    """level: a written table with n, bad, p0 (parent's mean). Adds mean, a and b of the posterior; the strength comes from one pass over the level.

    With v = p0(1-p0), n groups of labelled pages spread by S = sum of (bad - n p0)^2 / (n v), which is the sum of
    1 + (n-1) rho; the strength is 1/rho - 1.
    """
    v = F.col("p0") * (1 - F.col("p0"))
    seen = (F.col("n") > 0) & (v > 0)
    spread = F.sum(F.when(seen, (F.col("bad") - F.col("n") * F.col("p0")) ** 2 / (F.col("n") * v)))
    rho = F.try_divide(spread - F.sum(F.when(seen, 1)), F.sum(F.when(seen, F.col("n") - 1)))
    strength = F.when(rho > 0, F.least(F.greatest(1 / rho - 1, F.lit(WEAKEST)), F.lit(STRONGEST))).otherwise(F.lit(STRONGEST))
    k = F.lit(level.agg(strength.alias("k")).first().k)
    rows = level.withColumns({"a": F.col("p0") * k + F.col("bad"), "b": (1 - F.col("p0")) * k + F.col("n") - F.col("bad")})
    return rows.withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))


def _with_priors(level: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """The level's rows with p0 of their parent; parents: key, members (rows of the level that have the key), p0."""
    parents = written(parents, "priors")
    total = parents.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    return join_counted(level, parents, key, "members", total)


def host_reputation(outcomes: DataFrame, two_labels: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """outcomes: host, bad (0/1, or null if not labelled), a row per page; other columns are left out. Returns host, pages, n, mean, lower for every host.

    Counts are taken per host first, so a host with many pages is summed where its pages lie; every level is written once,
    with its parent's mean, and read for its strength and its posteriors. A domain of very many hosts, or a suffix of very
    many domains, is a hot key: its prior is broadcast, those of the others are joined.
    """
    hosts = outcomes.groupBy("host").agg(F.count("*").alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = written(hosts.withColumns({"domain": domain_of(F.col("host"), two_labels), "suffix": suffix_of(F.col("host"), two_labels)}), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    overall = hosts.agg((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).first()[0]
    domains = written(hosts.groupBy("domain", "suffix").agg(*sums, F.count("*").alias("members")), "domains")
    suffixes = domains.groupBy("suffix").agg(*sums, F.count("*").alias("members")).withColumn("p0", F.lit(overall))
    suffixes = _shrunk(written(suffixes, "suffixes")).select("suffix", "members", F.col("mean").alias("p0"))
    domains = _shrunk(written(_with_priors(domains.withColumnRenamed("members", "hosts"), suffixes, "suffix"), "domain-priors"))
    domains = domains.select("domain", F.col("hosts").alias("members"), F.col("mean").alias("p0"))
    found = _shrunk(written(_with_priors(hosts, domains, "domain"), "host-priors"))
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("a") + F.col("b") + 1))
    return found.select("host", "pages", "n", "mean", (F.col("mean") - Z * deviation).alias("lower"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", limit: float = LIMIT, two_labels: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """id_col, host, path, rule, verdict, bad_rate, bad_rate_lower of every page. outcomes: id_col and bad (0/1), any number per page.

    A host with very many pages is a hot key: its reputation is broadcast, those of the others are joined.
    """
    parsed = pages.select(id_col, url_host(url_col).alias("host"), url_path(url_col).alias("path"))
    labels = outcomes.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("bad").alias("bad"))
    reputation = host_reputation(parsed.join(labels, id_col, "left").select("host", "bad"), two_labels).drop("n")
    total = reputation.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    rows = parsed.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    judged = join_counted(rows, reputation, "host", "pages", total)
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("lower") > limit, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(id_col, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), F.col("mean").alias("bad_rate"), F.col("lower").alias("bad_rate_lower"))
