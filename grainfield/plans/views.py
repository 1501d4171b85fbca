"""The engine's input tables as views over the given tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()

VIEWS = {
    "targets": """SELECT c_custkey AS id, 'https://www.ort' || cast(c_custkey as string) || '.de/' AS url, c_name AS ort, lpad(cast(c_custkey as string), 8, '0') AS ags,
 n_name AS bundesland, c_mktsegment AS typ, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE last_order END AS last_scanned,
 CASE WHEN c_custkey % 17 = 0 THEN 'https://neu' || cast(c_custkey as string) || '.de/' END AS url_redirect, CASE WHEN c_custkey % 4 = 0 THEN 'HTTP_404' END AS crawl_error_code, cast(c_custkey % 3 as int) AS crawl_error_count
 FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_order FROM orders GROUP BY o_custkey) l ON o_custkey = c_custkey""",
    "region_mapping": """SELECT n_name AS bundesland, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name <> 'AFRICA'""",
    "findings": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE lpad(cast(o_custkey as string), 8, '0') END AS ags,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'Massnahme ' || o_orderpriority || ' Nr ' || cast(o_orderkey % 90 as string) END AS massnahme, o_orderpriority AS kategorie,
 CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'Hauptstr ' || cast(o_orderkey % 40 as string) || ', Ort' || cast(o_custkey % 9 as string) END AS adresse,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END AS end_time, o_orderdate AS gefunden_am, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice / 10000 END AS lat,
 CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice / 20000 END AS lng, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'street' ELSE 'city' END AS geo_level, o_orderstatus AS status,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE cast(cast(o_orderdate as date) as string) END AS massnahme_start,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN 'offen' ELSE cast(cast(o_orderdate as date) as string) END AS massnahme_ende FROM orders""",
    "changelog": """SELECT o_orderkey AS id, cast(o_orderkey % 3 as string) || '.' || cast(o_orderkey % 12 as string) || '.' || cast(o_orderkey as string) AS version, cast(o_orderdate as date) AS release_date, o_orderpriority AS title FROM orders""",
    "changelog_items": """SELECT CASE WHEN l_orderkey % 60 <> 0 THEN l_orderkey END AS changelog_id, l_linenumber AS sort_order, l_returnflag AS type,
 CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_linestatus END AS scope, 'item ' || cast(l_partkey as string) AS message FROM lineitem""",
    "history": """SELECT event_id AS id, ts AS created_at, event_type, 'user ' || cast(user_id as string) AS message FROM events""",
    "status_log": """SELECT user_id AS target, event_id AS pos,
 CASE WHEN event_id % 7 = 0 THEN 'ROBOTS' WHEN event_id % 5 = 0 THEN 'HTTP_404' WHEN event_id % 11 = 0 THEN 'DNS_TIMEOUT' WHEN event_id % 13 = 0 THEN 'EXTERNAL_REDIRECT:neu.de' ELSE 'OK' END AS status FROM events""",
    "usage": """SELECT event_id AS id, ts, user_id AS ort, event_type AS modell, cast(floor(coalesce(value, 0) * 100) as bigint) AS tokens, coalesce(value, 0) / 1000 AS cost, cast(event_id % 40 as double) / 8 AS latency, cast(event_id % 3 as int) AS finds FROM events""",
    "crawler_events": """SELECT cast(user_id % 60 as int) AS crawler, event_id AS pos, ts,
 CASE WHEN event_id % 7 = 0 THEN 'active' WHEN event_id % 7 = 1 THEN 'inactive' ELSE 'heartbeat' END AS event, 'ziel ' || cast(event_id % 50 as string) AS target FROM events""",
    "fetches": """SELECT page_id, url,
 CASE WHEN page_id % 7 = 0 THEN 404 WHEN page_id % 11 = 0 THEN 500 ELSE 200 END AS status,
 CASE WHEN page_id % 5 = 0 THEN 'https://a.de/impressum.html' WHEN page_id % 5 = 1 THEN 'https://a.de/Bild.PNG' ELSE url END AS target FROM pages""",
    "plan_files": """SELECT p_partkey AS pos, cast(p_partkey % 25 as int) AS target, 'https://x.de/' || CASE WHEN p_partkey % 5 = 0 THEN 'Bebauungsplan-' WHEN p_partkey % 5 = 1 THEN 'satzung_' ELSE 'info' END || CASE WHEN p_partkey % 3 = 0 THEN cast(2000 + p_partkey % 24 as string) ELSE '' END || '.pdf' AS url,
 CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 9 = 0 THEN 'unbekannt' ELSE 'D:' || cast(1990 + p_partkey % 35 as string) || '0101' END AS created FROM part""",
    "run_pages": """SELECT d.doc_id, d.source AS scenario,
 CASE WHEN floor(d.doc_id / 20) % 2 = 0 THEN 'focused' ELSE 'bfs' END AS mode, 'https://www.' || d.source || '.de/' || cast(d.doc_id % 40 as string) || '/' AS url, coalesce(l.quality, 0) = 1 AS is_relevant, (d.n_chars % 100) / 100.0 AS score,
 CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE d.n_chars % 3 > 0 END AS confirmed FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "notices": """SELECT doc_id, text || CASE WHEN doc_id % 6 = 0 THEN ' Der neue Bebauungsplan und die Ausschreibung der Vergabe' WHEN doc_id % 6 = 1 THEN ' Pressemitteilungen zum Breitbandausbau' WHEN doc_id % 6 = 2 THEN ' Radweg, öffentliche Auslegung und Sanierung' ELSE '' END AS text FROM documents""",
    "plan_pages": """SELECT page_id, url, replace(html, '</article>', '<p>Siehe ' || regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/plan' || cast(page_id as string) || '.pdf und https://anders.de/x.pdf <a href="/plan' || cast(page_id % 2 * page_id as string) || '.pdf">Plan</a></p></article>') AS html FROM pages""",
    "raw_log": """SELECT event_id AS id, 'https://www.seite' || cast(event_id % 700 as string) || '.de/' || event_type || '/' AS url, cast(event_id % 3 as int) AS run, ts AS crawled_at, value AS relevance_score FROM events""",
    "visits": """SELECT event_id AS pos, ts, 'host' || cast(user_id % 40 as string) AS host FROM events""",
    "answers": """SELECT o_orderkey AS id, 'https://www.ort' || cast(o_custkey as string) || '.de' AS url, CASE cast(o_orderkey % 6 as int)
 WHEN 0 THEN '```json' || chr(10) || '{"massnahmen": [{"massnahme": "Bau ' || cast(o_orderkey as string) || '", "kategorie": "Bauen", "adresse": "Weg ' || cast(o_custkey % 50 as string) || ', Dorf", "massnahme_start": "' || cast(cast(o_orderdate as date) as string) || '"}]}' || chr(10) || '```'
 WHEN 1 THEN '<think>hm {x}</think>{"funde": ["Titel ' || cast(o_orderkey as string) || '", "Zweiter"]}'
 WHEN 2 THEN '{"massnahmen": [{"titel": "Komma ' || cast(o_orderkey as string) || '", "category": "Verkehr", "url": "plan/a.pdf"},]}'
 WHEN 3 THEN ''
 WHEN 4 THEN 'kein json'
 ELSE '{"massnahme": "Einzeln ' || cast(o_orderkey as string) || '", "ende": "bald", "quelle_url": "https://x.de/' || cast(o_orderkey as string) || '"}' END AS raw FROM orders""",
    "gold": """SELECT page_id, url, page_id % 3 = 0 AS relevant, CASE WHEN page_id % 9 = 0 THEN NULL WHEN page_id % 2 = 0 THEN 'bauen' ELSE 'verwaltung' END AS kategorie FROM pages""",
    "chunk_finds": """SELECT conv_id AS target, turn AS grp, turn AS pos, substr(text, 1, 120) AS txt FROM conversations""",
    "runs": """SELECT d.doc_id, d.source AS scenario,
 CASE WHEN floor(d.doc_id / 20) % 2 = 0 THEN 'focused' ELSE 'bfs' END AS mode, coalesce(l.quality, 0) = 1 AS is_relevant, (d.n_chars % 100) / 100.0 AS score, d.lang AS top_category FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
}


def _needs(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b{t}\b", sql)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a view over given tables; plain projections and joins, so filters and columns reach the scan."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _needs(sql)}
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in frames:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}} AS {t}" if not re.search(rf"\b(?:FROM|JOIN) {t} [dl]\b", sql) else rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **frames)


def oracle(sql: str, *names: str) -> str:
    """The SQL with these views in front."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + " " + sql if names else sql
