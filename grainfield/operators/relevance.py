"""Relevance of texts and priority of links by a keyword model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainfield.functions.text import category_hits, coverage_score, keyword_numbers, normalize_text, numbered_hits
from grainfield.functions.urls import is_document, url_text

THRESHOLD, PRIORITY, ENSEMBLE = 0.15, 0.10, (0.4, 0.6)
# Weights of page, anchor, context and url in a link's priority, and the bonus of documents.
WEIGHTS = {"page": 0.20, "anchor": 0.40, "context": 0.25, "url": 0.15}
BONUS = 0.3
#: Models of more keywords are matched by an automaton.
MANY = 200


def with_hits(df: DataFrame, text: Column | str, model: dict[str, list[str]], out: str, most: int = MANY) -> DataFrame:
    """Adds category_hits() of a text. The normalised text is a column of its own, so it is made once and not for every keyword.

    Up to `most` keywords are columns; more are looked for by one automaton in Arrow batches, which costs the same for any number.
    """
    rows = df.withColumn("_norm", normalize_text(text))
    if sum(map(len, model.values())) <= most:
        return rows.withColumn(out, category_hits(F.col("_norm"), model)).drop("_norm")
    rows = rows.withColumn("_numbers", keyword_numbers([k for ks in model.values() for k in ks])(F.col("_norm")))
    return rows.withColumn(out, numbered_hits(F.col("_numbers"), model)).drop("_norm", "_numbers")


def classify(df: DataFrame, text: str, model: dict[str, list[str]], threshold: float = THRESHOLD, weights: tuple[float, float] = ENSEMBLE, most: int = 10) -> DataFrame:
    """tfidf_score, bayes_score, score, top_category (the first on ties), confidence, is_relevant, matched_keywords."""
    rows = with_hits(df, text, model, "_hits")
    shares = [F.struct((F.size(F.col("_hits")[c]) / F.lit(float(max(1, len(ks))))).alias("share"), F.lit(-i).alias("order"), F.lit(c).alias("category")) for i, (c, ks) in enumerate(model.items())]
    rows = rows.withColumns({"_cover": coverage_score(F.col("_hits"), model), "_top": F.array_max(F.array(*shares))})
    total = F.col("_cover") * weights[0] + F.col("_top.share") * weights[1]
    matched = F.slice(F.array_sort(F.array_distinct(F.flatten(F.map_values("_hits")))), 1, most)
    out = {
        "tfidf_score": F.col("_cover"), "bayes_score": F.round("_top.share", 4), "score": F.round(total, 4), "top_category": F.col("_top.category"),
        "confidence": F.round(F.least(F.lit(1.0), total / threshold * 0.5), 4), "is_relevant": total >= threshold, "matched_keywords": matched,
    }
    return rows.withColumns(out).drop("_hits", "_cover", "_top")


def relevance_label(relevant: Column | str) -> Column:
    """text of a verdict, null without one."""
    relevant = F.col(relevant) if isinstance(relevant, str) else relevant
    return F.when(relevant, "relevant").when(~relevant, "nicht relevant")


def two_gates(relevant: Column, confirmed: Column) -> Column:
    """Relevant by score, and confirmed by a model's answer or without one (null)."""
    return F.coalesce(relevant, F.lit(False)) & F.coalesce(confirmed, F.lit(True))


def score_links(links: DataFrame, model: dict[str, list[str]], threshold: float = PRIORITY) -> DataFrame:
    """links with page_score, anchor, context and url get the four scores, cpe_score, is_pdf and is_priority."""
    pdf = is_document("url")
    rows = with_hits(links, "anchor", model, "_anchor")
    rows = with_hits(rows, "context", model, "_context")
    rows = with_hits(rows, url_text("url"), model, "_url")
    of_url = F.least(F.lit(1.0), coverage_score(F.col("_url"), model) + F.when(pdf, BONUS).otherwise(0.0))
    scores = {"anchor_score": coverage_score(F.col("_anchor"), model), "context_score": coverage_score(F.col("_context"), model), "url_score": of_url, "is_pdf": pdf}
    rows = rows.withColumns(scores).drop("_anchor", "_context", "_url")
    total = F.round(sum((F.col(f"{k}_score") * w for k, w in WEIGHTS.items()), F.lit(0.0)), 4)
    return rows.withColumn("cpe_score", total).withColumn("is_priority", F.col("cpe_score") >= threshold)


def rank_links(scored: DataFrame) -> DataFrame:
    """Rank within the page: documents first, then by priority, in input order on ties."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("is_pdf"), F.desc("cpe_score"), "pos")))


def report(scored: DataFrame, by: list[str], corpus_size: int | None = None) -> DataFrame:
    """Per group counts, harvest rate, irrelevance ratio, mean score, approximate recall, F1; 4 decimals."""
    total, good = F.count("*"), F.count_if("is_relevant")
    rate = F.coalesce(F.try_divide(good, total), F.lit(0.0))
    recall = F.least(F.lit(1.0), good / corpus_size) if corpus_size else F.lit(0.0)
    out = scored.groupBy(*by).agg(total.alias("total_crawled"), good.alias("total_relevant"), (total - good).alias("total_irrelevant"), rate.alias("_hr"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 4).alias("avg_relevance_score"), recall.alias("_re"))
    f1 = F.coalesce(F.try_divide(2 * F.col("_hr") * F.col("_re"), F.col("_hr") + F.col("_re")), F.lit(0.0))
    return out.select(*by, "total_crawled", "total_relevant", "total_irrelevant", F.round("_hr", 4).alias("harvest_rate"), F.round(1 - F.col("_hr"), 4).alias("irrelevance_ratio"), "avg_relevance_score", F.round("_re", 4).alias("recall"), F.round(f1, 4).alias("f1_score"))
