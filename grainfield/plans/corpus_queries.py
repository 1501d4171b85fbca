"""Queries over answers, gold corpora, classifiers, texts and link graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainfield.functions import answers, text, urls
from grainfield.operators import bayes, corpus, frontier, gold
from grainfield.operators.tables import first_per_key
from grainfield.plans.page_queries import COMPARE, HOST, SEGMENTS
from grainfield.plans.views import oracle, table

QUERIES, ORACLE_SQL = {}, {}
TODAY = "1999-06-01"


def query(name: str, sql: str | None = None, *views: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = oracle(sql, *views)
        return f

    return add


@query("answers_parse", (
    "SELECT status, count(*) AS n, cast(sum(items) AS bigint) AS items FROM (SELECT CASE WHEN raw = '' THEN 'empty_response' WHEN raw LIKE 'kein%' THEN "
    "'parse_error' WHEN raw LIKE '%},]}' THEN 'repaired' ELSE 'ok' END AS status, CASE WHEN raw = '' OR raw LIKE 'kein%' THEN 0 WHEN raw LIKE '%funde%' "
    "THEN 2 ELSE 1 END AS items FROM answers) GROUP BY 1"
), "answers")
def answers_parse(spark, d):
    return answers.parse_answers(table(spark, d, "answers")).groupBy("status").agg(F.count("*").alias("n"), F.sum(F.size("items")).alias("items"))


ITEMS = r"""SELECT id, url, raw,
 CASE WHEN raw LIKE '%"massnahmen": [{"massnahme"%' THEN regexp_extract(raw, '"massnahme": "([^"]*)"', 1) WHEN raw LIKE '%titel%' THEN regexp_extract(raw, '"titel": "([^"]*)"', 1) WHEN raw LIKE '{"massnahme"%' THEN regexp_extract(raw, '"massnahme": "([^"]*)"', 1) WHEN raw LIKE '%funde%' THEN regexp_extract(raw, '"(Titel[^"]*)"', 1) END AS massnahme, 0 AS pos FROM answers WHERE raw LIKE '%{%' UNION ALL SELECT id, url, raw, 'Zweiter', 1 FROM answers WHERE raw LIKE '%funde%'"""
FOUND = rf"""SELECT id, url, pos, massnahme,
 CASE WHEN pos = 0 THEN nullif(regexp_extract(raw, '"(?:kategorie|category)": "([^"]*)"', 1), '') END AS kategorie, nullif(regexp_extract(raw, '"adresse": "([^"]*)"', 1), '') AS adresse, nullif(regexp_extract(raw, '"massnahme_start": "([^"]*)"', 1), '') AS start,
CASE WHEN raw LIKE '%plan/a.pdf%' THEN url || '/plan/a.pdf' WHEN raw LIKE '%quelle_url%' THEN regexp_extract(raw, '"quelle_url": "([^"]*)"', 1) ELSE url END AS quelle_url FROM ({ITEMS})"""


@query("findings_normalize", FOUND, "answers")
def findings_normalize(spark, d):
    return answers.findings(answers.parse_answers(table(spark, d, "answers"))).select("id", "url", "pos", "massnahme", "kategorie", "adresse", "start", "quelle_url")


@query("measure_records", (
    f"SELECT url, pos, CASE kategorie WHEN 'Bauen' THEN 'bauen' WHEN 'Verkehr' THEN 'infrastruktur' ELSE 'verwaltung' END AS kategorie_domain, "
    f"nullif(trim(regexp_extract(adresse, '([^,]*)$', 1)), '') AS ort, length(coalesce(massnahme, '')) > 0 AS gueltig FROM ({FOUND})"
), "answers")
def measure_records(spark, d):
    rows = answers.measure_records(answers.findings(answers.parse_answers(table(spark, d, "answers"))))
    return rows.select("url", "pos", "kategorie_domain", "ort", "gueltig")


@query("measures_by_category_place", (
    f"SELECT k AS kategorie, o AS ort, count(*) AS n FROM (SELECT CASE kategorie WHEN 'Bauen' THEN 'bauen' WHEN 'Verkehr' THEN 'infrastruktur' ELSE "
    f"'verwaltung' END AS k, coalesce(nullif(trim(regexp_extract(adresse, '([^,]*)$', 1)), ''), '(unbekannt)') AS o FROM ({FOUND})) "
    f"GROUP BY GROUPING SETS ((k), (o))"
), "answers")
def measures_by_category_place(spark, d):
    rows = answers.measure_records(answers.findings(answers.parse_answers(table(spark, d, "answers"))))
    rows = rows.select(F.col("kategorie_domain").alias("kategorie"), F.coalesce("ort", F.lit("(unbekannt)")).alias("ort"))
    return rows.groupingSets([["kategorie"], ["ort"]], "kategorie", "ort").agg(F.count("*").alias("n"))


@query("currency_filter", f"SELECT id FROM findings WHERE coalesce(massnahme_start, massnahme_ende) IS NOT NULL AND coalesce(TRY_CAST(massnahme_ende AS DATE) >= DATE '{TODAY}' - INTERVAL 36 MONTH, true)", "findings")
def currency_filter(spark, d):
    cut = F.add_months(F.lit(TODAY).cast("date"), -36)
    rows = table(spark, d, "findings").where(F.coalesce("massnahme_start", "massnahme_ende").isNotNull())
    return rows.where(F.coalesce(F.col("massnahme_ende").try_cast("date") >= cut, F.lit(True))).select("id")


@query("quality_issues", (
    f"SELECT id, array_to_string(list_filter([CASE WHEN length(coalesce(massnahme, '')) < 25 THEN 'short_title' END, CASE WHEN length(coalesce(adresse, "
    f"'')) < 5 THEN 'generic_address' END, CASE WHEN massnahme_start IS NULL AND massnahme_ende IS NULL THEN 'no_date' END, CASE WHEN massnahme_ende < "
    f"'{TODAY}' THEN 'expired' END], lambda x: x IS NOT NULL), ',') AS issues FROM findings"
), "findings")
def quality_issues(spark, d):
    rows = table(spark, d, "findings")
    longer = F.when(F.length("massnahme") >= 25, F.col("massnahme"))
    issues = answers.quality_issues(longer, F.col("adresse"), F.col("massnahme_start"), F.col("massnahme_ende"), F.lit("https://x.de"), TODAY)
    return rows.select("id", F.array_join(issues, ",").alias("issues"))


@query("truth_validity", (
    f"SELECT id, coalesce(length(massnahme) >= 15 AND length(coalesce(adresse, '')) >= 5 AND (massnahme_start IS NOT NULL OR massnahme_ende IS NOT NULL) "
    f"AND (massnahme_ende IS NULL OR massnahme_ende >= '{TODAY}'), false) AS ok FROM findings"
), "findings")
def truth_validity(spark, d):
    rows = table(spark, d, "findings")
    issues = answers.quality_issues(F.col("massnahme"), F.col("adresse"), F.col("massnahme_start"), F.col("massnahme_ende"), F.lit("https://x.de"), TODAY)
    return rows.select("id", (F.size(issues) == 0).alias("ok"))


WORDS = r"list_filter(list_distinct(regexp_split_to_array(lower({}), '[ \t\n]+')), lambda w: w <> '')"


@query("overlap_f1", (
    f"SELECT conv_id, turn, CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0 WHEN len(p) = 0 OR len(g) = 0 THEN 0.0 ELSE round(2.0 * len(list_intersect(p, g)) "
    f"/ (len(p) + len(g)), 4) END AS f1 FROM (SELECT a.conv_id, a.turn, {WORDS.format('a.text')} AS p, {WORDS.format('b.text')} AS g FROM conversations a "
    f"JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
))
def overlap_f1(spark, d):
    a = table(spark, d, "conversations")
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", text.overlap_f1(F.array("text"), F.array("gold")).alias("f1"))


@query("gold_recall", (
    f"SELECT count(*) AS total_relevant, count(h) AS found, round(count(h) / count(*), 4) AS recall FROM (SELECT DISTINCT {COMPARE} AS k FROM gold "
    f"WHERE relevant) w LEFT JOIN (SELECT DISTINCT {COMPARE} AS h FROM pages JOIN labels ON doc_id = page_id) v ON h = k"
), "gold")
def gold_recall(spark, d):
    """Visited are the pages that have a label."""
    visited = table(spark, d, "pages").join(table(spark, d, "labels").select(F.col("doc_id").alias("page_id")), "page_id", "left_semi")
    return gold.recall(table(spark, d, "gold"), visited.select("url"))


PARENT = f"{HOST} || '/' || array_to_string(list_slice({SEGMENTS}, 1, 1), '/')"


@query("gold_rollup", (
    f"WITH g AS (SELECT *, {PARENT} AS parent FROM gold), c AS (SELECT parent, relevant, kategorie, count(*) AS n, min_by(url, (length(url), page_id)) AS "
    f"shortest FROM g GROUP BY 1, 2, 3) SELECT shortest AS url, relevant, kategorie, 'aggregiert' AS quelle, cast(n AS integer) AS urls FROM c WHERE n >= 3 "
    f"UNION ALL SELECT g.url, g.relevant, g.kategorie, NULL, 0 FROM g JOIN c ON g.parent = c.parent AND g.relevant = c.relevant AND g.kategorie IS NOT "
    f"DISTINCT FROM c.kategorie WHERE n < 3"
))
def gold_rollup(spark, d):
    return gold.rollup(table(spark, d, "gold"), 1, 3)


from grainfield.plans.views import VIEWS  # noqa: E402

ORACLE_SQL["gold_rollup"] = ORACLE_SQL["gold_rollup"].replace("WITH g AS", f"WITH gold AS ({VIEWS['gold']}), g AS")


@query("gold_distribution", "SELECT kategorie, count(*) AS n FROM gold WHERE relevant AND kategorie <> '' GROUP BY 1", "gold")
def gold_distribution(spark, d):
    return table(spark, d, "gold").where("relevant and kategorie <> ''").groupBy("kategorie").agg(F.count("*").alias("n"))


MET_SQL = f"SELECT DISTINCT {HOST} AS host FROM pages UNION SELECT 'www.ort' || cast(c_custkey AS string) || '.de' FROM customer WHERE c_acctbal > 0"


@query("domain_mismatch", (
    f"SELECT domain, NOT coalesce(bool_or(contains(host, domain) OR contains(domain, host)), false) AS mismatch FROM (SELECT unnest(['example.com', 'example.org', 'muster.de', 'de', 'x']) AS domain "
    f"UNION ALL SELECT 'ort' || cast(c_custkey AS string) || '.de' FROM customer) LEFT JOIN ({MET_SQL}) ON true GROUP BY 1"
))
def domain_mismatch(spark, d):
    customers = table(spark, d, "customer")
    name = F.concat(F.lit("ort"), F.col("c_custkey").cast("string"), F.lit(".de"))
    domains = spark.createDataFrame([(x,) for x in ("example.com", "example.org", "muster.de", "de", "x")], "domain string").union(customers.select(name))
    hosts = table(spark, d, "pages").select(urls.authority("url").alias("host")).union(customers.where("c_acctbal > 0").select(F.concat(F.lit("www."), name)))
    return gold.domain_mismatch(domains, hosts)


RATES = (
    "SELECT scenario, coalesce(avg(CASE WHEN is_relevant THEN 1.0 ELSE 0.0 END) FILTER (mode = 'focused'), 0) AS hf, coalesce(avg(CASE WHEN is_relevant "
    "THEN 1.0 ELSE 0.0 END) FILTER (mode = 'bfs'), 0) AS hb, coalesce(avg(score) FILTER (mode = 'focused'), 0) AS sf, coalesce(avg(score) FILTER (mode = "
    "'bfs'), 0) AS sb FROM runs GROUP BY 1"
)


@query("baseline_compare", (
    f"SELECT scenario, round(hf, 4) AS hr_focused, round(hb, 4) AS hr_bfs, round(hf - hb, 4) AS delta_hr, round(sf - sb, 4) AS delta_score, round(CASE WHEN "
    f"hb > 0 THEN (hf - hb) / hb * 100 ELSE 0 END, 2) AS improvement, CASE WHEN hf > hb THEN 'focused' ELSE 'bfs' END AS winner FROM ({RATES})"
), "runs")
def baseline_compare(spark, d):
    return gold.compare_runs(table(spark, d, "runs"))


@query("comparison_table", " UNION ALL ".join(f"SELECT scenario, '{m}' AS metrik, {e} AS wert FROM ({RATES})" for m, e in (("hr_focused", "round(hf, 4)"), ("hr_bfs", "round(hb, 4)"), ("delta_hr", "round(hf - hb, 4)"), ("delta_score", "round(sf - sb, 4)"), ("improvement", "round(CASE WHEN hb > 0 THEN (hf - hb) / hb * 100 ELSE 0 END, 2)"))), "runs")
def comparison_table(spark, d):
    return gold.comparison_table(gold.compare_runs(table(spark, d, "runs")))


@query("harvest_at_k", (
    "SELECT scenario, round(coalesce(avg(CASE WHEN is_relevant THEN 1.0 ELSE 0.0 END) FILTER (place <= 10), 0), 4) AS hr_at_10, round(coalesce(avg(CASE "
    "WHEN is_relevant THEN 1.0 ELSE 0.0 END) FILTER (place <= 50), 0), 4) AS hr_at_50 FROM (SELECT *, row_number() OVER (PARTITION BY scenario "
    "ORDER BY score DESC, doc_id) AS place FROM runs) GROUP BY 1"
), "runs")
def harvest_at_k(spark, d):
    from grainfield.operators.tables import window_rank

    ranked = window_rank(table(spark, d, "runs"), ["scenario"], F.desc("score"), F.col("doc_id")).withColumnRenamed("rank", "place")
    return frontier.harvest_at(ranked, [10, 50])


KEYWORDS = {"en": ["the", "and", "with", "thing"], "de": ["der", "und", "nicht", "des"], "fr": ["des", "dans", "les"], "es": ["las", "los", "que", "para"]}
KW_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{t}')" for c, ts in KEYWORDS.items() for t in ts) + ") v(category, term)"
TOKENS = "SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zäöüß][a-zäöüß-]{2,}')) AS term FROM documents) GROUP BY 1, 2"
IDF_SQL = f"SELECT term, count(DISTINCT category) AS df, ln({float(len(KEYWORDS))} / count(DISTINCT category)) AS idf FROM ({KW_SQL}) GROUP BY 1"
CATVEC = f"SELECT category, term, w / sqrt(sum(w * w) OVER (PARTITION BY category)) AS cw FROM (SELECT category, term, idf AS w FROM ({KW_SQL}) JOIN ({IDF_SQL}) USING (term))"


def keyword_table(spark):
    return spark.createDataFrame([(c, t) for c, ts in KEYWORDS.items() for t in ts], "category string, term string")


@query("idf", f"SELECT term, df, round(idf, 6) AS idf, cast(coalesce(sum(tf), 0) AS bigint) AS uses FROM ({IDF_SQL}) LEFT JOIN ({TOKENS}) USING (term) GROUP BY 1, 2, 3")
def idf(spark, d):
    uses = bayes.term_counts(table(spark, d, "documents"), "doc_id", "text", keyword_table(spark)).groupBy("term").agg(F.sum("tf").alias("uses"))
    return bayes.idf(keyword_table(spark)).join(uses, "term", "left").select("term", "df", F.round("idf", 6).alias("idf"), F.coalesce("uses", F.lit(0)).alias("uses"))


@query("tfidf_cosine", (
    f"SELECT doc_id, category, round(sum(w / norm * cw), 4) AS cosine FROM (SELECT doc_id, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER "
    f"(PARTITION BY doc_id)) AS norm FROM ({TOKENS}) JOIN ({IDF_SQL}) USING (term)) JOIN ({CATVEC}) USING (term) GROUP BY 1, 2"
))
def tfidf_cosine(spark, d):
    weights = bayes.idf(keyword_table(spark))
    vectors = bayes.unit_vectors(bayes.term_counts(table(spark, d, "documents"), "doc_id", "text", weights), "doc_id", weights)
    cats = bayes.unit_vectors(keyword_table(spark).withColumn("tf", F.lit(1)), "category", weights)
    return bayes.cosine(vectors, cats, "doc_id").select("doc_id", "category", F.round("cosine", 4).alias("cosine"))


def _nb(spark, d):
    docs = table(spark, d, "documents")
    counts = frontier.shared_table(bayes.term_tallies(docs, "doc_id", "text"), "term-counts")
    labels = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "relevant").otherwise("irrelevant").alias("class"))
    return docs, counts, bayes.train(counts, labels, "doc_id")


NB = (
    f"WITH tc AS ({TOKENS}), lab AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'relevant' ELSE 'irrelevant' END AS class "
    f"FROM labels), pairs AS (SELECT class, term, sum(tf) AS n FROM tc JOIN lab USING (doc_id) "
    f"GROUP BY 1, 2), size AS (SELECT class, sum(n) AS words, (SELECT count(DISTINCT term) FROM pairs) AS v FROM pairs "
    f"GROUP BY 1), prior AS (SELECT class, count(*) / (SELECT count(*) FROM lab) AS prior FROM lab GROUP BY 1)"
)


@query("nb_train", NB + " SELECT class, term, round((n + 1) / (words + v), 9) AS p FROM pairs JOIN size USING (class)")
def nb_train(spark, d):
    return _nb(spark, d)[2][1].select("class", "term", F.round("p", 9).alias("p"))


@query("nb_classify", NB + (
    ", lp AS (SELECT doc_id, class, ln(prior) + coalesce(s, 0) AS lp FROM (SELECT doc_id, class, prior FROM documents CROSS JOIN prior) LEFT "
    "JOIN (SELECT doc_id, z.class, sum(tf * ln((coalesce(n, 0) + 1) / (words + v))) AS s FROM tc SEMI JOIN pairs q USING (term) CROSS JOIN size z LEFT "
    "JOIN pairs p ON p.term = tc.term AND p.class = z.class GROUP BY 1, 2) USING (doc_id, class)) "
    "SELECT doc_id, max_by(class, lp) AS class, round(1 / (1 + exp(min(lp) - max(lp))), 4) AS posterior FROM lp GROUP BY 1"
))
def nb_classify(spark, d):
    docs, counts, (priors, terms) = _nb(spark, d)
    return bayes.classify(counts, docs, priors, terms, "doc_id").select("doc_id", "class", F.round("posterior", 4).alias("posterior"))


@query("chunk_overlap", (
    "SELECT doc_id, cast(start AS integer) AS start, substr(text, start + 1, 1000) AS body, CASE WHEN start > 0 THEN substr(text, start - 100 + 1, 100) "
    "END AS prefix FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 900)) AS start FROM documents)"
))
def chunk_overlap(spark, d):
    return table(spark, d, "documents").select("doc_id", F.inline(text.chunks("text", 1000, 100)))


@query("rolling_context", (
    "SELECT target, grp, array_to_string(list_slice(a, greatest(len(a) - 4, 1), len(a)), '#') AS context "
    "FROM (SELECT target, grp, coalesce(list(txt) OVER (PARTITION BY target ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS a "
    "FROM chunk_finds)"
), "chunk_finds")
def rolling_context(spark, d):
    return corpus.rolling_context(table(spark, d, "chunk_finds")).select("target", "grp", F.array_join("context", "#").alias("context"))


@query("assemble_text", "SELECT conv_id, substr(string_agg('=== ' || role || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY turn), 1, 2000) AS text FROM conversations GROUP BY 1")
def assemble_text(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("url"), "text")
    return corpus.assemble_text(rows, "conv_id", 2000, "turn")


@query("change_detection", "SELECT doc_id, sha256(CASE WHEN doc_id % 4 = 0 THEN text || 'x' ELSE text END) AS hash, doc_id % 9 = 0 AS is_new FROM documents WHERE doc_id % 4 = 0 OR doc_id % 9 = 0")
def change_detection(spark, d):
    docs = table(spark, d, "documents")
    new = docs.select("doc_id", F.sha2(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("hash"))
    return corpus.changed_pages(docs.where("doc_id % 9 <> 0").select("doc_id", F.sha2("text", 256).alias("hash")), new, ["doc_id"])


@query("page_hash_map", (
    f"WITH e AS (SELECT {HOST} AS host, {COMPARE} AS k, min(sha256(html)) AS h FROM pages GROUP BY 1, 2), s AS (SELECT host, cast(ceil(count(*) / 50.0) AS integer) AS pieces FROM e GROUP BY 1) "
    f"SELECT host, cast(cast('0x' || substr(md5(k), 1, 8) AS bigint) % pieces AS integer) AS piece, pieces, string_agg(k || '=' || h, ';' ORDER BY k, h) AS hashes FROM e JOIN s USING (host) GROUP BY ALL"
))
def page_hash_map(spark, d):
    rows = table(spark, d, "pages").select(urls.authority("url").alias("host"), urls.compare_key("url").alias("k"), F.sha2("html", 256).alias("h"))
    maps = corpus.page_hash_map(rows, "host", "k", "h", 50)
    return maps.select("host", "piece", "pieces", F.array_join(F.transform(F.array_sort(F.map_entries("page_hashes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("hashes"))


MEASURE = ("massnahme", "adresse", "start", "ende", "quelle_url")
ENDED = rf"SELECT *, CASE WHEN raw LIKE '%\"ende\": \"bald\"%' THEN NULL END AS ende FROM ({FOUND.replace('SELECT id, url, pos', 'SELECT id, url, raw, pos', 1)})"
QUOTED = lambda c: f"coalesce('\"' || replace({c}, '/', '/') || '\"', 'null')"
OUTPUT = "'{\"massnahmen\":[' || string_agg('{' || " + " || ',' || ".join(f"'\"{c}\":' || {QUOTED(c)}" for c in MEASURE) + " || '}', ',' ORDER BY id, pos) || ']}'"
LINES = "concat_ws(chr(10), " + ", ".join(f"'{label}' || nullif({c}, '')" for c, label in corpus.LABELS.items()) + ")"


PAIRS_SQL = (
    f"SELECT p.url, sha256(substr(coalesce(nullif(t.text, ''), 'Offizielle Website von ' || p.url || chr(10) || chr(10) || made), 1, 8000)) AS "
    f"input_sha256, output, n FROM (SELECT url, string_agg({LINES}, chr(10) || chr(10) ORDER BY id, pos) AS made, {OUTPUT} AS output, count(*) AS n "
    f"FROM ({ENDED}) GROUP BY 1) p LEFT JOIN (SELECT 'https://www.ort' || cast(page_id AS string) || '.de' AS url, html AS text "
    f"FROM pages) t ON t.url = p.url"
)


def _pairs(spark, d):
    """The stored text of a place is the page of its number; other places get a text made from the findings."""
    rows = answers.findings(answers.parse_answers(table(spark, d, "answers")))
    texts = table(spark, d, "pages").select(F.concat(F.lit("https://www.ort"), F.col("page_id").cast("string"), F.lit(".de")).alias("url"), F.col("html").alias("text"))
    return corpus.training_pairs(rows, texts, "url", "Finde Massnahmen")


@query("training_pairs", PAIRS_SQL, "answers")
def training_pairs(spark, d):
    return _pairs(spark, d).select("url", F.sha2("input", 256).alias("input_sha256"), "output", F.col("n").cast("long"))


@query("pairs_with_negatives", (
    f"SELECT 'Finde Massnahmen' AS instruction, input_sha256, output, 'massnahmen_count=' || cast(n AS string) || ';url=' || url AS metadata FROM ({PAIRS_SQL}) UNION ALL "
    f"SELECT 'Finde Massnahmen', sha256(text), '{{\"massnahmen\":[]}}', 'grund=Aufgabe;typ=negativ' FROM (SELECT *, row_number() OVER (ORDER BY item_id) AS r FROM benchmark) "
    f"WHERE r <= greatest(2, (SELECT count(*) FROM ({PAIRS_SQL})) // 5)"
), "answers")
def pairs_with_negatives(spark, d):
    pool = table(spark, d, "benchmark").select(F.col("item_id").alias("pos"), F.col("text").alias("input"), F.lit("Aufgabe").alias("reason"))
    told = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return corpus.with_negatives(_pairs(spark, d), pool, "Finde Massnahmen").select("instruction", F.sha2("input", 256).alias("input_sha256"), "output", told.alias("metadata"))


def _edges(spark, d):
    """Customers and suppliers (as negative numbers) joined by every order line, in both directions."""
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    pairs = line.join(orders, line.l_orderkey == orders.o_orderkey).select((-F.col("l_suppkey")).alias("s"), F.col("o_custkey").alias("c")).distinct()
    return pairs.select(F.explode(F.array(F.struct(F.col("s").alias("src"), F.col("c").alias("dst")), F.struct(F.col("c").alias("src"), F.col("s").alias("dst")))).alias("e")).select("e.*")


EDGES = "SELECT DISTINCT -l_suppkey AS src, o_custkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION SELECT DISTINCT o_custkey, -l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query("bfs_levels", (
    f"WITH RECURSIVE e AS ({EDGES}), r AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS level UNION SELECT dst, level + 1 FROM r JOIN e ON src = node "
    f"WHERE level < 12) SELECT node, min(level) AS level FROM r GROUP BY 1"
))
def bfs_levels(spark, d):
    return frontier.reach(_edges(spark, d), spark.createDataFrame([(1,)], "node long"))


LINK_SQL = "SELECT event_id AS pos, user_id % 20 AS target, 'https://s.de/' || cast(event_id % 97 as string) || '/' AS url, coalesce(value, 0) > 40 AS is_priority, event_id % 5 = 0 AS is_document FROM events"
QUEUE_SQL = (
    f"WITH l AS (SELECT *, {{front}} AS front FROM ({LINK_SQL})), f AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY pos) AS n FROM l WHERE pos % 97 >= 10) SELECT target, "
    f"cast(row_number() OVER (PARTITION BY target ORDER BY front DESC, CASE WHEN front THEN -n ELSE n END) AS integer) AS place, url FROM f WHERE n <= 300"
)


def _links(spark, d):
    e = table(spark, d, "events")
    url = F.concat(F.lit("https://s.de/"), (F.col("event_id") % 97).cast("string"), F.lit("/"))
    links = e.select(F.col("event_id").alias("pos"), (F.col("user_id") % 20).alias("target"), url.alias("url"), (F.coalesce("value", F.lit(0.0)) > 40).alias("is_priority"), (F.col("event_id") % 5 == 0).alias("is_document"))
    visited = links.where("pos % 97 < 10").select("target", "url").union(links.select("target", F.explode(F.array(*[F.lit(f"https://s.de/{i}") for i in range(10)])).alias("url")))
    return links, visited


@query("frontier_round", QUEUE_SQL.replace("{front}", "is_priority AND NOT is_document"))
def frontier_round(spark, d):
    return frontier.frontier_round(*_links(spark, d), 300)


@query("frontier_fifo", QUEUE_SQL.replace("{front}", "false"))
def frontier_fifo(spark, d):
    return frontier.frontier_round(*_links(spark, d), 300, "fifo")


BUDGET, CAP = 12, 25
FITS = "e.ok AND NOT list_contains(seen, e.node) AND NOT list_contains(hashes, e.hash)"
CRAWL_SQL = (
    f"WITH RECURSIVE e AS ({EDGES}), p AS (SELECT DISTINCT dst AS node, dst % 11 <> 0 AS ok, 'h' || cast(abs(dst) % 120 AS string) AS hash FROM e), "
    f"l AS (SELECT src AS now, list({{'node': node, 'ok': ok, 'hash': hash, 'front': {{front}}}} ORDER BY dst) AS links FROM (SELECT *, (src + dst) % 3 = 0 AS is_priority, "
    f"dst % 7 = 0 AS is_document FROM e) JOIN p ON dst = node GROUP BY 1), "
    f"s AS (SELECT n_name AS target, [{{'node': node, 'ok': ok, 'hash': hash}}] AS queue, cast([] AS bigint[]) AS seen, cast([] AS varchar[]) AS hashes, cast([] AS bigint[]) AS read, 0 AS step "
    f"FROM (SELECT n_name, -min(s_suppkey) AS node FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) JOIN p USING (node) UNION ALL "
    f"SELECT target, list_concat(list_concat(list_transform(list_reverse(list_filter(put, lambda x: x.front)), lambda x: {{'node': x.node, 'ok': x.ok, 'hash': x.hash}}), queue), "
    f"list_transform(list_filter(put, lambda x: NOT x.front), lambda x: {{'node': x.node, 'ok': x.ok, 'hash': x.hash}})), seen, hashes, read, step FROM ("
    f"SELECT t.*, list_slice(list_filter(coalesce(links, []), lambda x: NOT list_contains(seen, x.node)), 1, {CAP} - len(queue)) AS put FROM ("
    f"SELECT target, list_slice(queue, hit + 1, len(queue)) AS queue, list_concat(seen, list_transform(list_slice(queue, 1, hit), lambda e: e.node)) AS seen, list_append(hashes, queue[hit].hash) AS hashes, list_append(read, queue[hit].node) AS read, queue[hit].node AS now, step + 1 AS step "
    f"FROM (SELECT *, list_position(list_transform(queue, lambda e: {FITS}), true) AS hit FROM s WHERE step < {BUDGET}) WHERE hit > 0) t LEFT JOIN l USING (now))) "
)
VISITS_SQL = CRAWL_SQL + "SELECT '{mode}' AS mode, target, unnest(range(1, len(read) + 1)) AS place, unnest(read) AS node FROM s WHERE step > 0 QUALIFY row_number() OVER (PARTITION BY target ORDER BY step DESC) = 1"
BOTH_SQL = " UNION ALL ".join(f"SELECT * FROM ({VISITS_SQL.replace('{mode}', m).replace('{front}', f)})" for m, f in (("focused", "is_priority AND NOT is_document"), ("fifo", "false")))


def _crawls(spark, d):
    """The same graph read in both orders: every nation's first supplier is where its crawl starts."""
    edges = frontier.shared_table(_edges(spark, d), "edges").withColumns({"pos": F.col("dst"), "is_priority": (F.col("src") + F.col("dst")) % 3 == 0, "is_document": F.col("dst") % 7 == 0})
    pages = edges.select(F.col("dst").alias("node")).distinct().select("node", (F.col("node") % 11 != 0).alias("ok"), F.concat(F.lit("h"), (F.abs("node") % 120).cast("string")).alias("hash"))
    nation = table(spark, d, "nation")
    seeds = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("target")).agg((-F.min("s_suppkey")).alias("node"))
    seeds = seeds.join(pages.select("node"), "node", "left_semi")
    return frontier.crawls(edges, seeds, BUDGET, CAP, {order: order for order in ("focused", "fifo")}, pages)


@query("crawl_visits", f"SELECT mode, target, cast(place AS integer) AS place, node FROM ({BOTH_SQL})")
def crawl_visits(spark, d):
    return _crawls(spark, d).select("mode", "target", "place", "node")


@query("crawl_harvest", (
    f"SELECT mode AS scenario, round(coalesce(avg(CASE WHEN rich THEN 1.0 ELSE 0.0 END) FILTER (place <= 5), 0), 4) AS hr_at_5, round(coalesce(avg(CASE WHEN rich THEN 1.0 ELSE 0.0 END) "
    f"FILTER (place <= 12), 0), 4) AS hr_at_12 FROM ({BOTH_SQL}) JOIN (SELECT c_custkey AS node, c_acctbal > 4500 AS rich FROM customer UNION ALL SELECT -s_suppkey, s_acctbal > 4500 FROM supplier) USING (node) GROUP BY 1"
))
def crawl_harvest(spark, d):
    rich = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), (F.col("c_acctbal") > 4500).alias("is_relevant"))
    rich = rich.union(table(spark, d, "supplier").select(-F.col("s_suppkey"), F.col("s_acctbal") > 4500))
    return frontier.harvest_at(_crawls(spark, d).join(rich, "node").withColumnRenamed("mode", "scenario"), [5, 12])


@query("first_links", f"SELECT target, url, min(pos) AS pos FROM ({LINK_SQL}) GROUP BY 1, 2")
def first_links(spark, d):
    return first_per_key(_links(spark, d)[0], ["target", "url"], "pos").select("target", "url", "pos")
