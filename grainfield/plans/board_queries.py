"""Queries over targets, findings and logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainfield.operators import operations as O
from grainfield.operators import tables as T
from grainfield.plans import dashboard as D
from grainfield.plans.views import oracle, table
from grainfield.streaming import jobs

MONTH, NOW, CUT = "1998-07-01 00:00:00", "1998-07-15 12:00:00", "2024-01-30 12:00:00"
QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None, *views: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = oracle(sql, *views)
        return f

    return add


JOINED = "findings f LEFT JOIN targets t ON f.ags = t.ags"


@query("findings_page", (
    f"SELECT f.id, f.ags, ort, bundesland, massnahme, kategorie, end_time FROM {JOINED} "
    f"WHERE massnahme IS NOT NULL AND bundesland = 'NATION_3' AND kategorie = '1-URGENT' ORDER BY end_time DESC NULLS FIRST, f.id LIMIT 50 OFFSET 50"
), "findings", "targets")
def findings_page(spark, d):
    return D.findings_page(table(spark, d, "findings"), table(spark, d, "targets"), 2, 50, bundesland="NATION_3", kategorie="1-URGENT", status="Alle")


@query("findings_search", (
    f"SELECT f.id, f.ags, ort, bundesland, massnahme, kategorie, end_time FROM {JOINED} "
    f"WHERE massnahme IS NOT NULL AND (massnahme ILIKE '%urgent nr 1%' OR adresse ILIKE '%urgent nr 1%' OR ort ILIKE '%urgent nr 1%') "
    f"ORDER BY end_time ASC NULLS LAST, f.id LIMIT 100"
), "findings", "targets")
def findings_search(spark, d):
    return D.findings_page(table(spark, d, "findings"), table(spark, d, "targets"), 1, 100, term="urgent nr 1", newest=False)


@query("findings_stats", (
    f"SELECT count(*) AS total, count(*) FILTER (gefunden_am >= date_trunc('month', TIMESTAMP '{NOW}')) AS this_month, count(*) FILTER (gefunden_am >= "
    f"date_trunc('day', TIMESTAMP '{NOW}')) AS today FROM findings WHERE massnahme IS NOT NULL"
), "findings")
def findings_stats(spark, d):
    return D.finding_stats(table(spark, d, "findings"), NOW)


@query("target_stats", f"SELECT count(*) AS total, count(*) FILTER (last_scanned >= TIMESTAMP '{MONTH}') AS done, count(*) - count(*) FILTER (last_scanned >= TIMESTAMP '{MONTH}') AS pending FROM targets", "targets")
def target_stats(spark, d):
    return D.target_stats(table(spark, d, "targets"), MONTH)


@query("targets_page", "SELECT id, ags, ort, bundesland, last_scanned FROM targets WHERE last_scanned IS NULL AND (ort ILIKE '%00%' OR ags ILIKE '%00%') ORDER BY id LIMIT 20 OFFSET 20", "targets")
def targets_page(spark, d):
    rows = table(spark, d, "targets").where(D.scan_status("pending") & D.search_filter("00", "ort", "ags") & D.equal_filters(bundesland="Alle"))
    return D.page(rows, 2, 20, F.col("id")).select("id", "ags", "ort", "bundesland", "last_scanned")


@query("target_by_id", "SELECT id, url, ort, ags FROM targets WHERE id = 42", "targets")
def target_by_id(spark, d):
    return table(spark, d, "targets").where("id = 42").select("id", "url", "ort", "ags")


@query("filter_options", (
    "SELECT 'bundesland' AS field, bundesland AS value FROM targets WHERE bundesland IS NOT NULL GROUP BY 2 UNION ALL SELECT 'kategorie', kategorie "
    "FROM findings WHERE kategorie IS NOT NULL GROUP BY 2"
), "targets", "findings")
def filter_options(spark, d):
    values = lambda df, c: df.select(F.lit(c).alias("field"), F.col(c).alias("value")).where("value is not null").distinct()
    return values(table(spark, d, "targets"), "bundesland").unionByName(values(table(spark, d, "findings"), "kategorie")).orderBy("field", "value")


@query("page_count", "SELECT kategorie, count(*) AS total, cast(greatest(1, ceil(count(*) / 50.0)) AS bigint) AS pages FROM findings WHERE massnahme IS NOT NULL GROUP BY 1", "findings")
def page_count(spark, d):
    return table(spark, d, "findings").where("massnahme is not null").groupBy("kategorie").agg(F.count("*").alias("total"), F.greatest(F.lit(1), F.ceil(F.count("*") / 50)).cast("long").alias("pages"))


@query("map_points", (
    "SELECT f.id, ort, lat, lng, geo_level = 'street' AS exact, end_time FROM findings f JOIN targets t ON f.ags = t.ags "
    "WHERE lat IS NOT NULL AND lng IS NOT NULL ORDER BY end_time DESC NULLS LAST, f.id LIMIT 500"
), "findings", "targets")
def map_points(spark, d):
    rows = D.with_targets(table(spark, d, "findings").where("lat is not null and lng is not null and not isnan(lat) and not isnan(lng)"), table(spark, d, "targets"), "inner")
    return rows.orderBy(F.col("end_time").desc_nulls_last(), "id").limit(500).select("id", "ort", "lat", "lng", (F.col("geo_level") == "street").alias("exact"), "end_time")


@query("region_counts", "SELECT region, count(*) AS n FROM findings f JOIN targets t ON f.ags = t.ags JOIN region_mapping r ON r.bundesland = t.bundesland GROUP BY 1", "findings", "targets", "region_mapping")
def region_counts(spark, d):
    rows = D.with_targets(table(spark, d, "findings"), table(spark, d, "targets"), "inner").join(table(spark, d, "region_mapping"), "bundesland")
    return rows.groupBy("region").agg(F.count("*").alias("n")).orderBy("region")


DUE = "SELECT ags, coalesce(url_redirect, url) AS url, t.bundesland, region, last_scanned FROM targets t LEFT JOIN region_mapping r ON r.bundesland = t.bundesland ORDER BY {} last_scanned ASC NULLS FIRST, ags LIMIT 100"


@query("due_targets", DUE.format(""), "targets", "region_mapping")
def due(spark, d):
    return D.due_targets(table(spark, d, "targets"), table(spark, d, "region_mapping"), None, 100)


@query("due_targets_region", DUE.format("CASE WHEN region = 'EUROPE' THEN 0 ELSE 1 END,"), "targets", "region_mapping")
def due_region(spark, d):
    return D.due_targets(table(spark, d, "targets"), table(spark, d, "region_mapping"), "EUROPE", 100)


@query("forced_union", "SELECT ags, forced FROM (SELECT ags, true AS forced FROM targets WHERE id IN (5, 10, 99) UNION ALL SELECT ags, false FROM targets WHERE id NOT IN (5, 10, 99) AND last_scanned IS NULL)", "targets")
def forced_union(spark, d):
    rows = table(spark, d, "targets")
    return rows.where(F.col("id").isin(5, 10, 99)).select("ags", F.lit(True).alias("forced")).unionByName(rows.where(~F.col("id").isin(5, 10, 99) & F.col("last_scanned").isNull()).select("ags", F.lit(False).alias("forced")))


@query("changelog_nested", (
    "SELECT version, release_date, title, CASE WHEN count(changelog_id) > 0 THEN '[' || string_agg('{\"tag\":\"' || type || '\",\"scope\":' || "
    "coalesce('\"' || scope || '\"', 'null') || ',\"description\":\"' || message || '\"}', ',' "
    "ORDER BY sort_order, type, scope NULLS FIRST, message) || ']' END AS items FROM changelog LEFT JOIN changelog_items ON changelog_id = id "
    "GROUP BY id, version, release_date, title"
), "changelog", "changelog_items")
def changelog_nested(spark, d):
    return D.changelog(table(spark, d, "changelog"), table(spark, d, "changelog_items")).orderBy(F.desc("release_date"), F.desc("version"))


@query("history_top20", (
    "SELECT string_agg(strftime(created_at, '%Y-%m-%d %H:%M:%S') || ' [' || event_type || '] ' || message, chr(10) "
    "ORDER BY created_at DESC, id DESC) AS text FROM (SELECT * FROM history ORDER BY created_at DESC, id DESC LIMIT 20)"
), "history")
def history_top20(spark, d):
    return T.history_text(table(spark, d, "history"), 20)


@query("history_retention", "SELECT id, created_at, event_type FROM history ORDER BY created_at DESC, id DESC LIMIT 200", "history")
def history_retention(spark, d):
    return T.keep_newest(table(spark, d, "history"), 200, F.col("created_at").desc(), F.col("id").desc()).select("id", "created_at", "event_type")


@query("status_view", (
    f"SELECT message, max(created_at) AS last_heartbeat, max_by(event_type, (created_at, id)) AS status, cast(trunc((epoch_us(TIMESTAMP '{CUT}') - "
    f"epoch_us(max(created_at))) / 1e6) AS integer) AS age_seconds, CASE WHEN trunc((epoch_us(TIMESTAMP '{CUT}') - epoch_us(max(created_at))) / 1e6) > "
    f"86400 THEN 'inactive' ELSE 'active' END AS effective FROM history GROUP BY 1"
), "history")
def status_view(spark, d):
    return D.status_view(table(spark, d, "history"), CUT, 86400)


@query("geocode_requests", (
    "SELECT f.id, CASE WHEN length(coalesce(adresse, '')) > 5 THEN adresse || ', ' || ort || ', ' || bundesland ELSE ort || ', ' || bundesland || ', "
    "Deutschland' END AS request, CASE WHEN length(coalesce(adresse, '')) > 5 THEN 'street' ELSE 'city' END AS level FROM findings f "
    "JOIN targets t ON f.ags = t.ags WHERE lat IS NULL AND massnahme IS NOT NULL"
), "findings", "targets")
def geocode_requests(spark, d):
    return D.geocode_requests(table(spark, d, "findings"), table(spark, d, "targets"))


@query("apply_coordinates", "SELECT id, CASE WHEN id % 6 = 0 THEN id / 7.0 ELSE lat END AS lat, CASE WHEN id % 6 = 0 THEN 'city' ELSE geo_level END AS geo_level FROM findings", "findings")
def apply_coordinates(spark, d):
    base = table(spark, d, "findings")
    new = base.where("id % 6 = 0").select("id", (F.col("id") / 7.0).alias("lat"), F.lit("city").alias("geo_level"))
    return T.apply_updates(base, new, "id").select("id", "lat", "geo_level")


@query("upsert_raw_log", "SELECT url, id, run, crawled_at FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY run DESC, crawled_at DESC, id DESC) AS r FROM raw_log) WHERE r = 1", "raw_log")
def upsert_raw_log(spark, d):
    log = table(spark, d, "raw_log").select("url", "run", "crawled_at", "id")
    base = T.latest_per_key(log.where("run < 2"), ["url"], "run", "crawled_at", "id")
    return T.upsert(base, T.latest_per_key(log.where("run = 2"), ["url"], "run", "crawled_at", "id"), ["url"]).select("url", "id", "run", "crawled_at")


@query("insert_if_absent", (
    "SELECT id, ags, massnahme FROM (SELECT *, row_number() OVER (PARTITION BY ags, lower(trim(massnahme)), massnahme_start ORDER BY id) AS r "
    "FROM findings f WHERE id % 2 = 1 AND massnahme IS NOT NULL) b WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM findings s "
    "WHERE s.id % 2 = 0 AND s.massnahme IS NOT NULL AND s.ags IS NOT DISTINCT FROM b.ags AND lower(trim(s.massnahme)) = lower(trim(b.massnahme)) AND "
    "s.massnahme_start IS NOT DISTINCT FROM b.massnahme_start)"
), "findings")
def insert_if_absent(spark, d):
    rows = table(spark, d, "findings").where("massnahme is not null").select("id", "ags", "massnahme", "massnahme_start")
    key = {"a": F.col("ags"), "m": F.lower(F.trim("massnahme")), "s": F.col("massnahme_start")}
    return T.insert_if_absent(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), key, "id").select("id", "ags", "massnahme")


@query("error_bookkeeping", (
    "SELECT ags, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'HTTP_500' ELSE crawl_error_code END AS crawl_error_code, CASE WHEN id % 3 = 0 THEN 0 "
    "WHEN id % 3 = 1 THEN coalesce(crawl_error_count, 0) + 1 ELSE crawl_error_count END AS crawl_error_count FROM targets"
), "targets")
def error_bookkeeping(spark, d):
    rows = table(spark, d, "targets")
    outcomes = rows.where("id % 3 < 2").select("ags", (F.col("id") % 3 == 0).alias("ok"), F.lit("HTTP_500").alias("code"))
    return T.error_bookkeeping(rows, outcomes)


@query("schema_evolution", "SELECT id, ort, 'crawler' AS source, cast(NULL AS double) AS lat FROM targets", "targets")
def schema_evolution(spark, d):
    new = {"source": ("string", "crawler"), "lat": ("double", None), "ort": ("string", "x")}
    return T.add_columns(T.add_columns(table(spark, d, "targets").select("id", "ort"), new), new)


@query("validate_rows", "SELECT id, coalesce(massnahme IS NOT NULL AND TRY_CAST(massnahme_ende AS DATE) IS NOT NULL, false) AS stored FROM findings", "findings")
def validate_rows(spark, d):
    good, bad = T.split_rejected(table(spark, d, "findings"), F.col("massnahme").isNotNull() & F.col("massnahme_ende").try_cast("date").isNotNull())
    return good.select("id", F.lit(True).alias("stored")).unionByName(bad.select("id", F.lit(False).alias("stored")))


KIND = (
    "CASE WHEN status = 'OK' THEN 'ok' WHEN status IN ('ROBOTS', 'SENSITIVE') THEN 'skipped' WHEN starts_with(status, 'EXTERNAL_REDIRECT') THEN 'redirect' "
    "WHEN status = 'DNS_TIMEOUT' THEN 'timeout' WHEN starts_with(status, 'HTTP_') THEN 'http_error' ELSE 'error' END"
)


@query("outcome_class", f"SELECT {KIND} AS kind, count(*) AS n, max(CASE WHEN starts_with(status, 'EXTERNAL_REDIRECT:') THEN 'https://' || substr(status, 19) END) AS target FROM status_log GROUP BY 1", "status_log")
def outcome_class(spark, d):
    from grainfield.functions.urls import redirect_target

    return table(spark, d, "status_log").groupBy(O.outcome().alias("kind")).agg(F.count("*").alias("n"), F.max(redirect_target("status")).alias("target"))


@query("dominant_error", (
    "SELECT target, coalesce(max(status) FILTER (r = 1 AND status <> 'OK'), 'UNKNOWN') AS dominant "
    "FROM (SELECT target, status, row_number() OVER (PARTITION BY target ORDER BY CASE WHEN status = 'OK' THEN 1 ELSE 0 END, count(*) DESC, min(pos)) AS r "
    "FROM status_log GROUP BY target, status) GROUP BY target"
), "status_log")
def dominant_error(spark, d):
    return O.dominant_status(table(spark, d, "status_log"))


@query("error_histogram", "SELECT status, count(*) AS n FROM status_log WHERE status <> 'OK' GROUP BY 1", "status_log")
def error_histogram(spark, d):
    return table(spark, d, "status_log").where("status <> 'OK'").groupBy("status").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status")


@query("run_summary", (
    f"SELECT count(*) AS processed, count(*) FILTER (k = 'ok') AS success, count(*) FILTER (k = 'redirect') AS redirects, count(*) FILTER (k IN "
    f"('http_error', 'timeout', 'error')) AS errors FROM (SELECT {KIND} AS k FROM status_log)"
), "status_log")
def run_summary(spark, d):
    return O.run_summary(table(spark, d, "status_log"))


@query("status_codes", "SELECT target, array_to_string(list_sort(list_distinct(list(status))), ',') AS codes FROM status_log GROUP BY 1", "status_log")
def status_codes(spark, d):
    return table(spark, d, "status_log").groupBy("target").agg(F.array_join(F.array_sort(F.collect_set("status")), ",").alias("codes"))


@query("running_cost", "SELECT id, round(sum(cost) OVER (ORDER BY ts, id ROWS UNBOUNDED PRECEDING), 6) AS total FROM usage", "usage")
def running_cost(spark, d):
    return O.prefix_sums(table(spark, d, "usage"), "cost", "ts", "id", "total").select("id", F.round("total", 6).alias("total"))


@query("daily_counter", "SELECT id, row_number() OVER (PARTITION BY cast(ts AS date) ORDER BY ts, id) AS n FROM usage", "usage")
def daily_counter(spark, d):
    return O.daily_counter(table(spark, d, "usage"), "ts", "id", "n").select("id", F.col("n").cast("long"))


@query("crawl_delay_audit", (
    "SELECT host, count(*) AS visits, count(*) FILTER (gap < 30) AS too_early FROM (SELECT host, cast(floor((epoch_us(ts) - epoch_us(lag(ts) OVER "
    "(PARTITION BY host ORDER BY ts, pos))) / 1e6) AS bigint) AS gap FROM visits) GROUP BY 1"
), "visits")
def crawl_delay_audit(spark, d):
    return O.crawl_delay_audit(table(spark, d, "visits"), 30).groupBy("host").agg(F.count("*").alias("visits"), F.count_if("too_early").alias("too_early"))


@query("rate_window_audit", (
    "SELECT id, count(*) OVER w AS window_requests, cast(sum(tokens) OVER w AS bigint) AS window_tokens, row_number() OVER (PARTITION BY ort, cast(ts AS "
    "date) ORDER BY ts, id) AS day_request, count(*) OVER w > 2 OR sum(tokens) OVER w > 12000 AS over_limit, tokens >= 12000 AS oversize "
    "FROM (SELECT *, cast(floor(epoch_us(ts) / 1000000) AS bigint) AS sec FROM usage) WINDOW w AS (PARTITION BY ort "
    "ORDER BY sec RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW)"
), "usage")
def rate_window_audit(spark, d):
    return O.rate_windows(table(spark, d, "usage"), 3600, 2, 12_000).select("id", "window_requests", "window_tokens", F.col("day_request").cast("long"), "over_limit", "oversize")


@query("cost_by_model", (
    "SELECT ort, modell, round(sum(cost), 6) AS cost, count(*) AS chunks, cast(sum(tokens) AS bigint) AS tokens, round(sum(latency), 2) AS latency, "
    "cast(sum(finds) AS bigint) AS finds FROM usage GROUP BY 1, 2"
), "usage")
def cost_by_model(spark, d):
    return table(spark, d, "usage").groupBy("ort", "modell").agg(F.round(F.sum("cost"), 6).alias("cost"), F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"), F.round(F.sum("latency"), 2).alias("latency"), F.sum("finds").alias("finds"))


@query("event_counts", "SELECT date_trunc('day', created_at) AS day, event_type, count(*) AS n FROM history GROUP BY 1, 2", "history")
def event_counts(spark, d):
    return table(spark, d, "history").groupBy(F.window("created_at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


@query("session_liveness", (
    "SELECT message, count(*) AS sessions, max(n) AS longest FROM (SELECT message, s, count(*) AS n "
    "FROM (SELECT message, sum(CASE WHEN gap IS NULL OR gap >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY message ORDER BY created_at, id) AS s "
    "FROM (SELECT *, epoch_us(created_at) - epoch_us(lag(created_at) OVER (PARTITION BY message ORDER BY created_at, id)) AS gap FROM history)) "
    "GROUP BY 1, 2) GROUP BY 1"
), "history")
def session_liveness(spark, d):
    one = table(spark, d, "history").groupBy("message", F.session_window("created_at", "6 hours")).agg(F.count("*").alias("n"))
    return one.groupBy("message").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("distinct_content", "SELECT scenario AS target, hash, min(ts) AS ts FROM (SELECT source AS scenario, sha256(text) AS hash, date '2024-01-01' + cast(doc_id AS integer) AS ts FROM documents) GROUP BY 1, 2")
def distinct_content(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("target"), F.sha2("text", 256).alias("hash"), F.date_add(F.lit("2024-01-01"), F.col("doc_id").cast("int")).alias("ts"))
    return jobs.distinct_content(docs)


@query("request_rates", (
    "SELECT start, count(*) AS requests, cast(sum(tokens) AS bigint) AS tokens FROM (SELECT tokens, unnest(list_transform(range(0, 6), lambda i: to_timestamp(floor(epoch(ts) / 10) * 10 - 10 * i)::timestamp)) AS start "
    "FROM usage) GROUP BY 1"
), "usage")
def request_rates(spark, d):
    return jobs.rates(table(spark, d, "usage"))


@query("daily_findings", "SELECT date_trunc('day', ts) AS day, count(*) AS n FROM usage GROUP BY 1", "usage")
def daily_findings(spark, d):
    return jobs.daily_findings(table(spark, d, "usage"))


@query("monthly_findings", "SELECT date_trunc('month', ts) AS month, count(*) AS n FROM usage GROUP BY 1", "usage")
def monthly_findings(spark, d):
    return jobs.monthly_findings(table(spark, d, "usage"))
