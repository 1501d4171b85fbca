"""Queries over crawls, their logs and their documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainfield.functions import answers, text, urls
from grainfield.operators import corpus, html, operations, relevance
from grainfield.operators import tables as T
from grainfield.plans.page_queries import HOST, PATH, SITE
from grainfield.plans.views import oracle, table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None, *views: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = oracle(sql, *views)
        return f

    return add


@query(
    "status_row",
    """SELECT crawler, coalesce(arg_max(event, (ts, pos)) FILTER (event IN ('active', 'inactive')), 'inactive') AS status, max(ts) FILTER (event = 'active') AS started_at,
(arg_max({'v': CASE WHEN event = 'inactive' THEN ts END}, (ts, pos)) FILTER (event IN ('active', 'inactive'))).v AS stopped_at, max(ts) FILTER (event IN ('active', 'heartbeat')) AS last_heartbeat,
(arg_max({'v': CASE WHEN event IN ('active', 'heartbeat') THEN target END}, (ts, pos))).v AS current_target FROM crawler_events GROUP BY 1""",
    "crawler_events",
)
def status_row(spark, d):
    return T.status_row(table(spark, d, "crawler_events"), "crawler")


@query("insert_default", "SELECT ags, ort FROM targets UNION ALL SELECT '99999999', 'neu'", "targets")
def insert_default(spark, d):
    rows = table(spark, d, "targets").select("ags", "ort")
    new = spark.createDataFrame([("00000042", "da"), ("99999999", "neu")], "ags string, ort string")
    return T.insert_default(rows, new, "ags")


@query("upsert_master", "SELECT ags, CASE WHEN id % 4 = 0 THEN 'neu ' || ort ELSE ort END AS ort, url FROM targets", "targets")
def upsert_master(spark, d):
    rows = table(spark, d, "targets").select("id", "ags", "ort", "url")
    new = rows.where("id % 4 = 0").select("ags", F.concat(F.lit("neu "), "ort").alias("ort"), "url")
    return T.upsert(rows.where("id % 3 > 0 or id % 4 > 0").drop("id"), new, ["ags"])


@query("upsert_regions", "SELECT n_name AS bundesland, CASE WHEN r_name = 'AFRICA' THEN 'SUED' ELSE r_name END AS region FROM nation JOIN region ON r_regionkey = n_regionkey")
def upsert_regions(spark, d):
    rows = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_name").alias("bundesland"), F.col("r_name").alias("region"))
    return T.upsert(rows, rows.where("region = 'AFRICA'").withColumn("region", F.lit("SUED")), ["bundesland"])


@query("update_hashes", (
    "SELECT ags, CASE WHEN id % 3 = 0 THEN md5(url) ELSE md5(ort) END AS content_hash, CASE WHEN id % 3 = 0 THEN TIMESTAMP '1999-01-01 00:00:00' ELSE "
    "last_scanned END AS last_scanned FROM targets"
), "targets")
def update_hashes(spark, d):
    rows = table(spark, d, "targets").withColumn("content_hash", F.md5("ort"))
    new = rows.where("id % 3 = 0").select("ags", F.md5("url").alias("content_hash"), F.lit("1999-01-01 00:00:00").cast(rows.schema["last_scanned"].dataType).alias("last_scanned"))
    return T.apply_updates(rows.select("ags", "content_hash", "last_scanned"), new, "ags")


@query("lookup_found", (
    "SELECT asked, t.id IS NOT NULL AS found, ort, massnahme FROM (SELECT 42 AS asked UNION ALL SELECT -1) LEFT JOIN targets t ON t.id = asked LEFT "
    "JOIN (SELECT id, massnahme FROM findings) f ON f.id = asked"
), "targets", "findings")
def lookup_found(spark, d):
    rows = [T.by_key(table(spark, d, "targets"), "id", v).select("asked", "found", "ort") for v in (42, -1)]
    finds = [T.by_key(table(spark, d, "findings"), "id", v).select("asked", "massnahme") for v in (42, -1)]
    return rows[0].unionByName(rows[1]).join(finds[0].unionByName(finds[1]), "asked").select(F.col("asked").cast("int"), "found", "ort", "massnahme")


@query("forced_targets", "SELECT ags, id IN (5, 10, 99) AS forced FROM targets WHERE id IN (5, 10, 99) OR id NOT IN (1, 2, 3, 5)", "targets")
def forced_targets(spark, d):
    return T.forced(table(spark, d, "targets"), "id", [5, 10, 99], [1, 2, 3, 5]).select("ags", "forced")


@query("fetch_filter", (
    f"SELECT page_id, regexp_matches(lower(target), 'impressum|datenschutz|kontakt|sitemap|login|\\.jpg|\\.png|\\.gif|\\.svg|\\.webp') AS ignored, "
    f"starts_with({PATH}, '/en/') AS in_scope FROM fetches WHERE status = 200"
), "fetches")
def fetch_filter(spark, d):
    """P13, P15, P18."""
    rows = table(spark, d, "fetches").where("status = 200")
    return rows.select("page_id", urls.is_ignored("target").alias("ignored"), urls.in_sub_path("url", F.lit("https://x.de/en/")).alias("in_scope"))


@query("two_gates", "SELECT doc_id, CASE WHEN is_relevant THEN 'relevant' ELSE 'nicht relevant' END AS label, is_relevant AND coalesce(confirmed, true) AS stored FROM run_pages", "run_pages")
def two_gates(spark, d):
    return table(spark, d, "run_pages").select("doc_id", relevance.relevance_label("is_relevant").alias("label"), relevance.two_gates(F.col("is_relevant"), F.col("confirmed")).alias("stored"))


@query("page_budget", (
    "SELECT scenario, mode, doc_id, cast(place AS integer) AS place FROM (SELECT *, row_number() OVER (PARTITION BY scenario, mode "
    "ORDER BY doc_id) AS place FROM run_pages) WHERE place <= 20"
), "run_pages")
def page_budget(spark, d):
    rows = table(spark, d, "run_pages").withColumn("run", F.struct("scenario", "mode"))
    return operations.within_budget(rows, "run", 20, "doc_id").select("scenario", "mode", "doc_id", "place")


@query("seed_filter", "SELECT ags FROM targets WHERE lower(bundesland) = 'nation_3' AND id % 900 >= 100 AND id NOT IN (103, 203)", "targets")
def seed_filter(spark, d):
    rows = table(spark, d, "targets").withColumn("einwohner", (F.col("id") % 900).cast("string"))
    return corpus.seed_filter(rows, rows.where("id in (103, 203)").select("url"), "Nation_3", 100).select("ags")


@query("known_category", "SELECT kategorie, count(*) AS n, kategorie IN ('1-URGENT', '2-HIGH') AS known FROM findings GROUP BY 1", "findings")
def known_category(spark, d):
    rows = table(spark, d, "findings").groupBy("kategorie").agg(F.count("*").alias("n"))
    return rows.withColumn("known", answers.known_category("kategorie", ["1-URGENT", "2-HIGH"]))


YEAR = "coalesce(TRY_CAST(nullif(regexp_extract(string_split(url, '/')[-1], '(20[0-9][0-9])', 1), '') AS INTEGER), 9999)"
FIRST = "regexp_matches(lower(string_split(url, '/')[-1]), '" + "|".join(urls.PRIORITY_WORDS) + "')"


@query("document_order", (
    f"SELECT target, url, pos, cast(row_number() OVER (PARTITION BY target ORDER BY CASE WHEN {FIRST} THEN 0 ELSE 1 END, CASE WHEN {FIRST} THEN 0 ELSE "
    f"-{YEAR} END, pos) AS integer) AS rank FROM plan_files WHERE coalesce(TRY_CAST(substr(created, 3, 4) AS INTEGER) >= 2000, true)"
), "plan_files")
def document_order(spark, d):
    """F16, F17, O10, P29, U6."""
    rows = table(spark, d, "plan_files").where(urls.is_recent_document("created", 2000))
    return T.window_rank(rows, ["target"], *urls.document_order("url", "pos")).select("target", "url", "pos", "rank")


ANCHORS = (
    f"SELECT page_id, {SITE} || h AS url FROM (SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS h "
    f"FROM plan_pages) WHERE starts_with(h, '/') AND NOT regexp_matches(lower(h), '\\.({'|'.join(urls.SKIP_ENDINGS)})$')"
)
PATTERN = f"SELECT DISTINCT page_id, url FROM (SELECT page_id, {HOST} AS host, unnest(regexp_extract_all(html, 'https?://[^\\s\"<>]+\\.[pP][dD][fF]')) AS url FROM plan_pages) WHERE {HOST} = host"


@query("pdf_links", PATTERN, "plan_pages")
def pdf_links(spark, d):
    return html.document_links(table(spark, d, "plan_pages")).select("page_id", "url")


@query("all_links", (
    f"SELECT page_id, url, CASE WHEN bool_or(a) THEN 'anchor' ELSE 'pattern' END AS source FROM (SELECT page_id, url, true AS a FROM ({ANCHORS}) UNION ALL "
    f"SELECT page_id, url, false FROM ({PATTERN})) GROUP BY 1, 2"
), "plan_pages")
def all_links(spark, d):
    pages = table(spark, d, "plan_pages")
    return html.all_links(html.parse_pages(pages), pages).select("page_id", "url", "source")


@query("pattern_only_links", f"SELECT page_id, url FROM ({PATTERN}) EXCEPT SELECT page_id, url FROM ({ANCHORS})", "plan_pages")
def pattern_only_links(spark, d):
    pages = table(spark, d, "plan_pages")
    return html.pattern_only(html.all_links(html.parse_pages(pages), pages))


@query("harvest_counts", (
    f"SELECT host, count(*) AS pages, count(*) FILTER (page_id % 2 = 0) AS unchanged, count(*) - count(DISTINCT h) AS duplicates "
    f"FROM (SELECT page_id, {HOST} AS host, sha256(html) AS h FROM pages) GROUP BY 1"
))
def harvest_counts(spark, d):
    rows = table(spark, d, "pages").select(urls.authority("url").alias("host"), F.col("page_id").alias("url_key"), F.sha2("html", 256).alias("hash"))
    stored = rows.withColumn("hash", F.when(F.col("url_key") % 2 == 0, F.col("hash")).otherwise("x"))
    return operations.harvest_counts(rows, stored, "host").select("host", "pages", "unchanged", "duplicates")


@query("session_totals", "SELECT modell, round(sum(cost), 6) AS cost, count(*) AS requests FROM usage GROUP BY 1", "usage")
def session_totals(spark, d):
    return operations.session_totals(table(spark, d, "usage"), ["modell"])


@query("version_flags", "SELECT id, version, row_number() OVER (ORDER BY release_date DESC, id DESC) = 1 AS is_current, row_number() OVER (ORDER BY release_date, id) = 1 AS is_first FROM changelog", "changelog")
def version_flags(spark, d):
    from grainfield.plans.dashboard import version_flags

    return version_flags(table(spark, d, "changelog"))


DAY = "CASE WHEN len(string_split({0}, '-')) = 3 THEN string_split({0}, '-')[3] || '.' || string_split({0}, '-')[2] || '.' || string_split({0}, '-')[1] ELSE nullif({0}, '') END"
FROM, TO = DAY.format("massnahme_start"), DAY.format("massnahme_ende")


@query("display_columns", (
    f"SELECT id, coalesce(strftime(end_time, '%d.%m.%Y %H:%M'), '-') AS shown, strftime(end_time, '%Y-%m-%dT%H:%M:%S') AS iso, CASE WHEN massnahme_start IS "
    f"NOT NULL AND massnahme_ende IS NOT NULL THEN massnahme_start || ' – ' || massnahme_ende ELSE coalesce(massnahme_start, massnahme_ende, '-') END AS "
    f"span, CASE WHEN massnahme_start IS NOT NULL OR massnahme_ende IS NOT NULL THEN coalesce({FROM}, '?') || ' – ' || coalesce({TO}, '?') END AS map_span "
    f"FROM findings"
), "findings")
def display_columns(spark, d):
    start, end = F.col("massnahme_start"), F.col("massnahme_ende")
    return table(spark, d, "findings").select("id", text.display_time(F.col("end_time")).alias("shown"), text.iso_time(F.col("end_time")).alias("iso"), text.date_range_text(start, end).alias("span"), text.map_range_text(start, end).alias("map_span"))


@query("text_limits", (
    "SELECT doc_id, cast(length(text) // 4 AS bigint) AS tokens, sha256(substr(text, 1, 500)) AS head, "
    "array_to_string(list_slice(list_sort(list_filter(['and', 'der', 'que', 'tion', 'zz'], lambda k: contains(lower(text), k))), 1, 3), ',') AS hits "
    "FROM documents"
))
def text_limits(spark, d):
    hits = text.substring_hits(F.col("text"), ["and", "der", "que", "tion", "zz"], 3)
    return table(spark, d, "documents").select("doc_id", text.token_estimate("text").alias("tokens"), F.sha2(text.sanitize_text("text", 500), 256).alias("head"), F.array_join(hits, ",").alias("hits"))


FLAT = "translate(lower(substr(text, 1, 80)), 'áàâãåéèêëíìîïóòôõúùûñçýÿ', 'aaaaaeeeeiiiioooouuuncyy')"
for _a, _b in text.UMLAUTS:
    FLAT = f"replace({FLAT}, '{_a}', '{_b}')"


@query("slugs", rf"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace({FLAT}, '\s+', ' ', 'g')), '[^a-z0-9 _-]+', '', 'g'), '[ _-]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM documents")
def slugs(spark, d):
    return table(spark, d, "documents").select("doc_id", text.slugify(F.substring("text", 1, 80)).alias("slug"))


@query("instruction_texts", (
    "SELECT doc_id, sha256('<start_of_turn>user' || chr(10) || 'Kategorien: bauen, verwaltung. Stichtag 1999-06-01; nichts, was mehr als drei Jahre vorher "
    "endete. Basis: ' || 'https://' || source || '.de' || chr(10) || '---' || chr(10) || substr(text, 1, 12000) || '<end_of_turn>' || chr(10) || "
    "'<start_of_turn>model' || chr(10) || '{}' || '<end_of_turn>') AS chat_sha256 FROM documents"
))
def instruction_texts(spark, d):
    """F46, F47, F56."""
    base = F.concat(F.lit("https://"), "source", F.lit(".de"))
    asked = corpus.instruction_text(F.col("text"), base, ["bauen", "verwaltung"], "1999-06-01")
    return table(spark, d, "documents").select("doc_id", F.sha2(corpus.chat_text(asked, F.lit(""), F.lit("{}")), 256).alias("chat_sha256"))


@query("seed_select", (
    "SELECT ags, override FROM (SELECT ags, true AS override, 0 AS r FROM targets WHERE id IN (3, 4) UNION ALL "
    "SELECT ags, false, row_number() OVER (ORDER BY md5('42#' || ags), ags) FROM targets WHERE id NOT IN (3, 4)) WHERE r <= 98"
), "targets")
def seed_select(spark, d):
    rows = table(spark, d, "targets")
    return corpus.seed_select(rows, rows.where("id in (3, 4)").select("ags"), "ags", 100, 42)


@query("train_eval_split", f"SELECT doc_id, CASE WHEN substr(md5('42#' || cast(doc_id AS string)), 1, 8) < '{int(0.1 * (1 << 32)):08x}' THEN 'eval' ELSE 'train' END AS part FROM documents")
def train_eval_split(spark, d):
    return corpus.train_eval_split(table(spark, d, "documents"), "doc_id", 0.1, 42).select("doc_id", "part")


@query("robots_filter", (
    f"SELECT page_id, url, NOT (starts_with({PATH}, '/en/') AND NOT starts_with({PATH}, '/en/1')) AND NOT starts_with({PATH}, '/de/') AS allowed, "
    f"cast(greatest(2.0, 5.0) AS double) AS delay, starts_with({PATH}, '/fr/') AS other_allowed FROM pages"
))
def robots_filter(spark, d):
    """Three agents share a group, another one has its own."""
    pages = table(spark, d, "pages")
    txt = "User-agent: *\nUser-agent: erster\nUser-agent: zweiter\nAllow: /en/1\nDisallow: /en/ # english\nDisallow: /de/\nCrawl-delay: 2\n\nUser-agent: dritter\nAllow: /fr/\nDisallow: /\nCrawl-delay: 9"
    rules = html.robots_rules(pages.select(urls.authority("url").alias("host")).distinct().withColumn("txt", F.lit(txt)))
    other = html.robots_allowed(pages, rules, "Dritter/1.0").select("page_id", F.col("allowed").alias("other_allowed"))
    rows = html.robots_allowed(pages, rules, "erster").join(other, "page_id")
    return rows.select("page_id", "url", "allowed", operations.effective_delay(F.col("delay"), 5.0).alias("delay"), "other_allowed")
