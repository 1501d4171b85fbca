"""Queries that evaluate runs and models, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainfield.functions import answers
from grainfield.operators import bayes, gold, models, relevance
from grainfield.plans.corpus_queries import CATVEC, FOUND, IDF_SQL, KEYWORDS, KW_SQL, TOKENS, WORDS, keyword_table
from grainfield.plans.page_queries import COMPARE
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


REPORT = """SELECT scenario, mode, count(*) AS total_crawled, count(*) FILTER (is_relevant) AS total_relevant, count(*) FILTER (is_relevant) / count(*) AS hr0,
 round(count(*) FILTER (is_relevant) / count(*), 4) AS harvest_rate,
 round(1 - count(*) FILTER (is_relevant) / count(*), 4) AS irrelevance_ratio,
 round(avg(score), 4) AS avg_relevance_score,
least(1.0, count(*) FILTER (is_relevant) / 40.0) AS re0 FROM run_pages GROUP BY 1, 2"""
REPORT = f"SELECT *, round(re0, 4) AS recall, round(CASE WHEN hr0 + re0 = 0 THEN 0.0 ELSE 2 * hr0 * re0 / (hr0 + re0) END, 4) AS f1_score FROM ({REPORT})"
WANTED = f"SELECT DISTINCT scenario, {COMPARE} AS key FROM run_pages JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l USING (doc_id) WHERE scenario <> 'src1'"
BLOCKS = f"""SELECT r.*, t.total IS NOT NULL AS gold_available,
 round(coalesce(coalesce(found, 0) / t.total, 0), 4) AS gold_recall, coalesce(t.total, 0) AS gold_total FROM ({REPORT}) r
 LEFT JOIN (SELECT scenario, count(*) AS total FROM ({WANTED}) GROUP BY 1) t ON t.scenario = r.scenario
LEFT JOIN (SELECT scenario, mode, count(*) AS found FROM (SELECT DISTINCT scenario, mode, {COMPARE} AS key FROM run_pages) JOIN ({WANTED}) USING (scenario, key) GROUP BY 1, 2) h ON h.scenario = r.scenario AND h.mode = r.mode"""
BLOCKS = f"SELECT *, CASE WHEN gold_available AND harvest_rate + gold_recall > 0 THEN round(2 * harvest_rate * gold_recall / (harvest_rate + gold_recall), 4) ELSE 0.0 END AS gold_f1 FROM ({BLOCKS})"


def _blocks(spark, d):
    """Reports per scenario and mode; the gold corpus are the urls of documents of high quality, and one scenario has none."""
    pages = table(spark, d, "run_pages")
    good = table(spark, d, "labels").where("quality = 1").select("doc_id").distinct()
    wanted = pages.join(good, "doc_id", "left_semi").where("scenario <> 'src1'").select("scenario", "url", F.lit(True).alias("relevant"))
    return gold.gold_blocks(relevance.report(pages, ["scenario", "mode"], 40), pages.select("scenario", "mode", "url"), wanted)


@query("gold_blocks", f"SELECT scenario, mode, harvest_rate, recall, f1_score, gold_available, gold_recall, gold_f1, gold_total FROM ({BLOCKS})", "run_pages")
def gold_blocks(spark, d):
    return _blocks(spark, d).select("scenario", "mode", "harvest_rate", "recall", "f1_score", "gold_available", "gold_recall", "gold_f1", "gold_total")


@query(
    "compare_reports",
    f"""SELECT scenario, round(f.harvest_rate - b.harvest_rate, 4) AS harvest_rate_delta, CASE WHEN b.harvest_rate > 0 THEN round((f.harvest_rate - b.harvest_rate) / b.harvest_rate * 100, 2) ELSE 0.0 END AS improvement,
round(CASE WHEN f.gold_available AND b.gold_available THEN f.gold_recall - b.gold_recall ELSE f.recall - b.recall END, 4) AS recall_delta,
 round(CASE WHEN f.gold_available AND b.gold_available THEN f.gold_f1 - b.gold_f1 ELSE f.f1_score - b.f1_score END, 4) AS f1_delta,
CASE WHEN f.gold_available AND b.gold_available THEN 'goldstandard' ELSE 'reference_corpus_size_approx' END AS recall_source,
 round(f.avg_relevance_score - b.avg_relevance_score, 4) AS score_delta, f.harvest_rate > b.harvest_rate AS focused_wins
FROM (SELECT * FROM ({BLOCKS}) WHERE mode = 'focused') f JOIN (SELECT * FROM ({BLOCKS}) WHERE mode = 'bfs') b USING (scenario)""",
    "run_pages",
)
def compare_reports(spark, d):
    return gold.compare_reports(_blocks(spark, d))


METRICS = [("Harvest Rate", "harvest_rate", "round(f.harvest_rate - b.harvest_rate, 4)"), ("Irrelevance Ratio", "irrelevance_ratio", "-round(f.harvest_rate - b.harvest_rate, 4)"), ("Avg Score", "avg_relevance_score", "round(f.avg_relevance_score - b.avg_relevance_score, 4)"), ("Total Crawled", "total_crawled", "0.0"), ("Total Relevant", "total_relevant", "0.0"), ("F1-Score", "f1_score", "0.0")]


@query("metric_table", " UNION ALL ".join((
    f"SELECT scenario, '{n}' AS metrik, cast(f.{c} AS double) AS focused, cast(b.{c} AS double) AS bfs, cast({delta} AS double) AS delta FROM (SELECT * "
    f"FROM ({REPORT}) WHERE mode = 'focused') f JOIN (SELECT * FROM ({REPORT}) WHERE mode = 'bfs') b USING (scenario)"
) for n, c, delta in METRICS), "run_pages")
def metric_table(spark, d):
    return gold.metric_table(relevance.report(table(spark, d, "run_pages"), ["scenario", "mode"], 40))


from grainfield.plans.corpus_queries import ORACLE_SQL as _corpus  # noqa: E402


@query("gold_file_totals")
def gold_file_totals(spark, d):
    return gold.file_totals(gold.rollup(table(spark, d, "gold"), 1, 3))


_head, _rest = _corpus["gold_rollup"].split(" SELECT shortest AS url", 1)
ORACLE_SQL["gold_file_totals"] = f"{_head} SELECT count(*) AS total_entries, count(*) FILTER (relevant) AS total_relevant, count(*) FILTER (quelle = 'aggregiert') AS merged FROM (SELECT shortest AS url{_rest})"

GOLDEN = "CASE WHEN id % 6 = 0 THEN 'Bau ' || cast(id as string) WHEN id % 6 = 1 THEN 'Titel ' || cast(id as string) WHEN id % 6 = 4 THEN '' ELSE 'Etwas anderes' END"
ISSUES = (
    f"list_filter([CASE WHEN length(coalesce(massnahme, '')) < 15 THEN 'short_title' END, CASE WHEN length(coalesce(adresse, '')) < 5 THEN "
    f"'generic_address' END, CASE WHEN start IS NULL THEN 'no_date' END, CASE WHEN NOT regexp_matches(quelle_url, '^https?://') THEN 'bad_url' END], lambda "
    f"x: x IS NOT NULL)"
)
EXAMPLES = f"""SELECT a.id,
 CASE WHEN a.id % 3 = 0 THEN 'basis' ELSE 'finetuned' END AS modell, (a.id % 47) / 10.0 AS latency, {GOLDEN.replace('id', 'a.id')} AS gold, coalesce(f.titles, '') AS titles, coalesce(f.n, 0) AS pred, coalesce(f.valid, 0) AS valid FROM answers a
LEFT JOIN (SELECT id, string_agg(massnahme, ' ') AS titles, count(*) AS n, count(*) FILTER (len({ISSUES}) = 0) AS valid FROM ({FOUND}) GROUP BY 1) f ON f.id = a.id"""
SCORED = (
    f"SELECT *, CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0 WHEN len(p) = 0 OR len(g) = 0 THEN 0.0 ELSE round(2.0 * len(list_intersect(p, g)) / (len(p) + "
    f"len(g)), 3) END AS f1 FROM (SELECT *, {WORDS.format('titles')} AS p, {WORDS.format('gold')} AS g FROM ({EXAMPLES}))"
)


def _examples(spark, d):
    """Every answer is a model's for an example; its gold list is one title or none."""
    raw = table(spark, d, "answers").withColumn("modell", F.when(F.col("id") % 3 == 0, "basis").otherwise("finetuned")).withColumn("latency", (F.col("id") % 47) / 10.0)
    title = F.expr(GOLDEN)
    golden = raw.select("id", "modell", "latency", F.when(title == "", F.array().cast("array<string>")).otherwise(F.array(title)).alias("gold"))
    return golden, answers.findings(answers.parse_answers(raw.select("id", "url", "raw")))


@query("model_summary", (
    f"SELECT modell, count(*) AS n, round(avg(f1), 3) AS mean_f1, round(avg(pred), 1) AS mean_found, round(avg(valid), 1) AS mean_valid, "
    f"round(avg(latency), 1) AS mean_latency FROM ({SCORED}) GROUP BY 1"
), "answers")
def model_summary(spark, d):
    golden, found = _examples(spark, d)
    return models.model_summary(models.scored_examples(golden, found, TODAY))


@query("model_issues", (
    f"SELECT modell, issue, n FROM (SELECT *, row_number() OVER (PARTITION BY modell ORDER BY n DESC, issue) AS r "
    f"FROM (SELECT CASE WHEN id % 3 = 0 THEN 'basis' ELSE 'finetuned' END AS modell, issue, count(*) AS n FROM (SELECT id, unnest({ISSUES}) AS issue "
    f"FROM ({FOUND})) GROUP BY 1, 2)) WHERE r <= 5"
), "answers")
def model_issues(spark, d):
    golden, found = _examples(spark, d)
    return models.top_issues(golden, found, TODAY, 5)


SEEDED = f"SELECT category AS class, term AS text FROM ({KW_SQL}), range(3) UNION ALL SELECT category, string_agg(term, ' ') FROM ({KW_SQL}) GROUP BY 1"
SEEDNB = f"""WITH seeded AS ({SEEDED}), prior AS (SELECT class, count(*) / (SELECT count(*) FROM seeded) AS prior FROM seeded GROUP BY 1), pairs AS (SELECT class, term, count(*) AS n FROM (SELECT class, unnest(regexp_extract_all(lower(text), '[a-zäöüß][a-zäöüß-]{{2,}}')) AS term FROM seeded) GROUP BY 1, 2),
size AS (SELECT class, sum(n) AS words, (SELECT count(DISTINCT term) FROM pairs) AS v FROM pairs GROUP BY 1), tc AS (SELECT * FROM ({TOKENS}) SEMI JOIN pairs q USING (term)),
lp AS (SELECT doc_id, class, ln(prior) + coalesce(s, 0) AS lp FROM (SELECT doc_id, class, prior FROM documents CROSS JOIN prior)
 LEFT JOIN (SELECT doc_id, z.class, sum(tf * ln((coalesce(n, 0) + 1) / (words + v))) AS s FROM tc CROSS JOIN size z LEFT JOIN pairs p ON p.term = tc.term AND p.class = z.class GROUP BY 1, 2) USING (doc_id, class)),
post AS (SELECT doc_id, class, exp(lp - max(lp) OVER (PARTITION BY doc_id)) AS e FROM lp), ranked AS (SELECT doc_id, class, e / sum(e) OVER (PARTITION BY doc_id) AS p, row_number() OVER (PARTITION BY doc_id ORDER BY round(e, 9) DESC, class) AS r FROM post),
best AS (SELECT doc_id, max(class) FILTER (r = 1) AS class, max(p) FILTER (r = 1) AS posterior, max(p) FILTER (r = 1) - max(p) FILTER (r = 2) AS confidence FROM ranked GROUP BY 1),
cos AS (SELECT doc_id, category, sum(w / norm * cw) AS cosine FROM (SELECT doc_id, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS norm FROM ({TOKENS}) JOIN ({IDF_SQL}) USING (term)) JOIN ({CATVEC}) USING (term) GROUP BY 1, 2),
tops AS (SELECT doc_id, max(cosine) AS tfidf, string_agg(category, ',' ORDER BY round(cosine, 9) DESC, category) AS categories FROM cos WHERE cosine > 0 GROUP BY 1)"""


@query("legacy_ensemble", SEEDNB + (
    " SELECT *, score >= 0.15 AS is_relevant FROM (SELECT d.doc_id, round(coalesce(tfidf, 0), 4) AS tfidf_score, round(posterior, 4) AS bayes_score, round(confidence, 4) AS confidence, "
    "class AS top_category, coalesce(categories, '') AS categories, round(coalesce(tfidf, 0) * 0.4 + posterior * 0.6, 4) AS score FROM documents d JOIN best USING (doc_id) LEFT JOIN tops USING (doc_id))"
))
def legacy_ensemble(spark, d):
    """The classifier is trained on the keywords alone."""
    docs = table(spark, d, "documents")
    words = [(i, c, t) for i, (c, t) in enumerate((c, t) for c, ts in KEYWORDS.items() for t in ts)]
    seeded = bayes.seed_training(spark.createDataFrame(words, "pos int, category string, term string"))
    trained = bayes.train(bayes.term_counts(seeded, "doc", "text"), seeded.select("doc", "class"), "doc")
    weights = bayes.idf(keyword_table(spark))
    counts = bayes.term_counts(docs, "doc_id", "text", weights)
    cats = bayes.unit_vectors(keyword_table(spark).withColumn("tf", F.lit(1)), "category", weights)
    best = bayes.best_cosine(bayes.cosine(bayes.unit_vectors(counts, "doc_id", weights), cats, "doc_id"), docs, "doc_id")
    return bayes.ensemble(best, bayes.classify(counts, docs, *trained, "doc_id"), "doc_id").withColumn("categories", F.array_join("categories", ","))
