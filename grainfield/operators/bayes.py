"""Term vectors and a naive-Bayes classifier as tables."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfield.functions.text import TOKEN, tokens

UNSEEN = 1e-6
#: Terms with a larger share of a class are broadcast: fewer than classes / OFTEN.
OFTEN = 1e-4
#: The terms of so many texts are counted before they are handed on.
TEXTS = 64


def term_counts(docs: DataFrame, ident: str, text: str, among: DataFrame | None = None) -> DataFrame:
    """ident, term, tf of every document's tokens, or of those among the terms of a table, which are then all that is counted."""
    rows = docs.select(ident, F.explode(tokens(text)).alias("term"))
    rows = rows if among is None else rows.join(among.select("term").distinct(), "term", "left_semi")
    return rows.groupBy(ident, "term").agg(F.count("*").alias("tf"))


def _tallies(batches: Iterator) -> Iterator:
    import pyarrow as pa

    find = re.compile(TOKEN).findall
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            some = batch.slice(at, TEXTS)
            found = [Counter(find(t)) for t in some.column(1).to_pylist()]
            of = pa.array([i for i, c in enumerate(found) for _ in c], pa.int64())
            terms, tf = pa.array([t for c in found for t in c], pa.string()), pa.array([n for c in found for n in c.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([some.column(0).take(of), terms, tf], [batch.schema.names[0], "term", "tf"])


def term_tallies(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """As term_counts(), counted within each row and so without a shuffle: rows of the same ident count by themselves. train() and classify(), which only add up, take either."""
    rows = docs.select(ident, F.lower(F.coalesce(text, F.lit(""))).alias("_text"))
    return rows.mapInArrow(_tallies, f"`{ident}` {docs.schema[ident].dataType.simpleString()}, term string, tf long")


def idf(keywords: DataFrame) -> DataFrame:
    """ln(number of categories / categories of the term)."""
    n = keywords.select("category").distinct().count()
    return keywords.groupBy("term").agg(F.countDistinct("category").alias("df")).select("term", "df", F.log(F.lit(float(n)) / F.col("df")).alias("idf"))


def unit_vectors(counts: DataFrame, ident: str, weights: DataFrame) -> DataFrame:
    """Ident, term, weight = tf x idf, of length one; terms without idf are left out. Spark broadcasts the weights if they are few."""
    rows = counts.join(weights.select("term", "idf"), "term").select(ident, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = rows.groupBy(ident).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.join(norms, ident).where("norm > 0").select(ident, "term", (F.col("w") / F.col("norm")).alias("weight"))


def cosine(doc_vectors: DataFrame, category_vectors: DataFrame, ident: str) -> DataFrame:
    """ident, category, cosine where it is over 0."""
    c = category_vectors.select("category", "term", F.col("weight").alias("cw"))
    return doc_vectors.join(c, "term").groupBy(ident, "category").agg(F.sum(F.col("weight") * F.col("cw")).alias("cosine")).where("cosine > 0")


def best_cosine(found: DataFrame, docs: DataFrame, ident: str) -> DataFrame:
    """per document the greatest cosine (0 without any) and the categories over 0, best first, then by name."""
    best = found.groupBy(ident).agg(F.max("cosine").alias("score"), F.array_sort(F.collect_list(F.struct((-F.round("cosine", 9)).alias("c"), "category"))).alias("a"))
    rows = docs.select(ident).join(best, ident, "left")
    return rows.select(ident, F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce(F.transform("a", lambda x: x["category"]), F.array().cast("array<string>")).alias("categories"))


def seed_training(keywords: DataFrame, repeat: int = 3) -> DataFrame:
    """Doc, class, text: every keyword (pos, category, term) so many times, and one text of all keywords of a category."""
    each = keywords.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(repeat))))
    words = each.select(F.concat_ws("#", "category", "term", F.col("_copy").cast("string")).alias("doc"), F.col("category").alias("class"), F.col("term").alias("text"))
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]), " ")
    return words.unionByName(keywords.groupBy("category").agg(phrase.alias("text")).select(F.col("category").alias("doc"), F.col("category").alias("class"), "text"))


def ensemble(cosines: DataFrame, classified: DataFrame, ident: str, weights: tuple[float, float] = (0.4, 0.6), threshold: float = 0.15) -> DataFrame:
    """best_cosine() and classify() together: score, whether relevant, the classifier's class and confidence; weights and threshold are parameters."""
    rows = cosines.select(ident, F.col("score").alias("tfidf"), "categories").join(classified, ident)
    score = F.round(F.col("tfidf") * weights[0] + F.col("posterior") * weights[1], 4)
    return rows.select(ident, F.round("tfidf", 4).alias("tfidf_score"), F.round("posterior", 4).alias("bayes_score"), score.alias("score"), (score >= threshold).alias("is_relevant"), F.col("class").alias("top_category"), "categories", F.round("confidence", 4).alias("confidence"))


def train(counts: DataFrame, labels: DataFrame, ident: str) -> tuple[DataFrame, DataFrame]:
    """(class, prior) and (class, term, p) with Laplace smoothing over the whole vocabulary; only seen pairs are rows, `p0` is for the others."""
    classes = labels.groupBy("class").agg(F.count("*").alias("n"))
    total = classes.agg(F.sum("n").alias("all"))
    pairs = counts.join(labels, ident).groupBy("class", "term").agg(F.sum("tf").alias("n"))
    size = pairs.groupBy("class").agg(F.sum("n").alias("words"))
    vocabulary = pairs.agg(F.count_distinct("term").alias("v"))
    scale = size.crossJoin(F.broadcast(vocabulary))
    priors = classes.crossJoin(F.broadcast(total)).join(F.broadcast(scale), "class", "left").select("class", (F.col("n") / F.col("all")).alias("prior"), F.coalesce(1.0 / (F.col("words") + F.col("v")), F.lit(UNSEEN)).alias("p0"))
    terms = pairs.join(F.broadcast(scale), "class").select("class", "term", ((F.col("n") + 1) / (F.col("words") + F.col("v"))).alias("p"))
    return priors, terms


def classify(counts: DataFrame, docs: DataFrame, priors: DataFrame, terms: DataFrame, ident: str) -> DataFrame:
    """Ident, class (the likelier, the first by name on ties), posterior, confidence.

    A document's log score is the sum of log(p/p0) over its seen pairs, plus its words in the vocabulary times log p0,
    plus the log prior; words outside the vocabulary count the same for every class. Documents without words go by the priors.
    Classes are few: what a term adds to each is one map, so the terms of a document meet the vocabulary once, and each
    document is one row with a map of sums. Spark broadcasts the vocabulary where it is small; else frequent terms, which
    are hot keys, are broadcast by themselves and the others joined.
    """
    classes = priors.select("class", "prior", "p0").collect()  # a row per class
    lifted = terms.join(F.broadcast(priors.select("class", "p0")), "class")
    lift = [F.coalesce(F.max(F.when(F.col("class") == r["class"], F.log(F.col("p") / F.col("p0")))), F.lit(0.0)).alias(f"l{i}") for i, r in enumerate(classes)]
    vocabulary = lifted.groupBy("term").agg(*lift, F.max("p").alias("top"))
    often = vocabulary.where(F.col("top") > OFTEN).drop("top")
    rare = vocabulary.where(F.col("top") <= OFTEN).drop("top")
    hit = counts.join(F.broadcast(often), "term").unionByName(counts.join(F.broadcast(often.select("term")), "term", "left_anti").join(rare, "term"))
    sums = hit.groupBy(ident).agg(F.sum("tf").alias("words"), *[F.sum(F.col("tf") * F.col(f"l{i}")).alias(f"g{i}") for i in range(len(classes))])
    rows = docs.select(ident).distinct().join(sums, ident, "left")
    score = lambda i, r: F.lit(math.log(r["prior"])) + F.coalesce("words", F.lit(0)) * F.lit(math.log(r["p0"])) + F.coalesce(f"g{i}", F.lit(0.0))
    scored = rows.select(ident, F.array(*[F.struct(score(i, r).alias("lp"), F.lit(r["class"]).alias("class")) for i, r in enumerate(classes)]).alias("s"))
    best = F.array_max(F.transform("s", lambda x: x["lp"]))
    post = scored.withColumn("e", F.transform("s", lambda x: F.struct(F.exp(x["lp"] - best).alias("e"), x["class"].alias("class"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x["e"])
    ranked = post.withColumn("p", F.array_sort(F.transform("e", lambda x: F.struct((-F.round(x["e"] / total, 12)).alias("down"), x["class"].alias("class"), (x["e"] / total).alias("p")))))
    second = F.coalesce(F.get("p", 1)["p"], F.lit(0.0))
    return ranked.select(ident, F.col("p")[0]["class"].alias("class"), F.col("p")[0]["p"].alias("posterior"), (F.col("p")[0]["p"] - second).alias("confidence"))
