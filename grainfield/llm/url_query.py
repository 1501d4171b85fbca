"""Query op3: a verdict on every page's url. The labelled outcome of a page is the label row with its id: bad if toxic or of low quality."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfield.llm.url_reputation import LIMIT, STRONGEST, TWO_LABEL_SUFFIXES, WEAKEST, Z, filter_urls

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = F.when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), ((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).cast("int"))
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    found = filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), outcomes, RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


def _level(name: str, source: str, key: str) -> str:
    seen = "n > 0 AND p0 * (1 - p0) > 0"
    rho = f"((sum(CASE WHEN {seen} THEN (bad - n * p0) * (bad - n * p0) / (n * p0 * (1 - p0)) END) - sum(CASE WHEN {seen} THEN 1 END)) / nullif(sum(CASE WHEN {seen} THEN n - 1 END), 0))"
    strength = f"CASE WHEN {rho} > 0 THEN least(greatest(1 / {rho} - 1, {WEAKEST}), {STRONGEST}) ELSE {STRONGEST} END"
    return f"""{name} AS (SELECT {key}, (p0 * k + bad) / (k + n) AS mean, k + n AS ab FROM {source} CROSS JOIN (SELECT {strength} AS k FROM {source}))"""


def _sql() -> str:
    two = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
    tail = lambda n: f"array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - {n - 1}, 1), len(string_split(host, '.'))), '.')"
    is_two = f"{tail(2)} IN ({two})"
    fit = "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{v} {r}'" for v, r in sorted(RULES, key=lambda x: -len(x[1])) for h, _, p in [r.partition("/")]) + " END"
    return rf"""
WITH parsed AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
lab AS (SELECT doc_id, max(CASE WHEN toxic IS NOT NULL OR quality IS NOT NULL THEN CASE WHEN coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 THEN 1 ELSE 0 END END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
counted AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM parsed LEFT JOIN lab ON doc_id = page_id GROUP BY 1),
hosts AS (SELECT *, CASE WHEN {is_two} THEN {tail(3)} ELSE {tail(2)} END AS domain, CASE WHEN {is_two} THEN {tail(2)} ELSE {tail(1)} END AS suffix FROM counted),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 0.5) / (sum(n) + 1) FROM hosts) AS p0 FROM domains GROUP BY 1),
{_level("s1", "suffixes", "suffix")},
d0 AS (SELECT domain, n, bad, mean AS p0 FROM domains JOIN s1 USING (suffix)),
{_level("d1", "d0", "domain")},
h0 AS (SELECT host, n, bad, mean AS p0 FROM hosts JOIN d1 USING (domain)),
{_level("h1", "h0", "host")},
judged AS (SELECT page_id, host, path, {fit} AS fit, CASE WHEN mean - {Z} * sqrt(mean * (1 - mean) / (ab + 1)) > {LIMIT} THEN 'block' ELSE 'allow' END AS own FROM parsed JOIN h1 USING (host))
SELECT page_id, host, path, substr(fit, 7) AS rule, coalesce(substr(fit, 1, 5), own) AS verdict FROM judged"""


QUERIES = {"op3_url_filter": op3_url_filter}
ORACLE_SQL = {"op3_url_filter": _sql()}
