"""Gold corpora and the evaluation of runs against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainfield.functions.urls import compare_key, parent_key


def recall(gold: DataFrame, visited: DataFrame) -> DataFrame:
    """Distinct relevant keys, how many were visited, recall to 4 decimals (0 without any)."""
    wanted = gold.where("relevant").select(compare_key("url").alias("key")).distinct()
    seen = visited.select(compare_key("url").alias("key")).distinct().withColumn("hit", F.lit(1))
    both = wanted.join(seen, "key", "left")
    return both.agg(F.count("*").alias("total_relevant"), F.count("hit").alias("found"), F.round(F.coalesce(F.try_divide(F.count("hit"), F.count("*")), F.lit(0.0)), 4).alias("recall"))


def rollup(gold: DataFrame, depth: int, least: int) -> DataFrame:
    """Groups of one parent and label with enough rows become the shortest url (the first on ties), with their number; other rows stay.

    The urls themselves are listed for small groups alone (fewer than `least`), so that no group is gathered whole: of a
    larger one a window keeps the first row.
    """
    rows = gold.withColumn("parent", parent_key("url", depth))
    key = ["parent", "relevant", "kategorie"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.length("url"), "page_id"))
    few = rows.withColumn("place", place).where(F.col("place") < least).select(*key, "place", "url")
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n"))
    same = few["parent"].eqNullSafe(sizes["parent"]) & few["relevant"].eqNullSafe(sizes["relevant"]) & few["kategorie"].eqNullSafe(sizes["kategorie"])
    both = few.join(sizes, same).select(few["url"], few["place"], few["relevant"], few["kategorie"], "n").where((F.col("n") < least) | (F.col("place") == 1))
    many = F.col("n") >= least
    return both.select("url", "relevant", "kategorie", F.when(many, "aggregiert").alias("quelle"), F.when(many, F.col("n")).otherwise(0).cast("int").alias("urls"))


def file_totals(rolled: DataFrame) -> DataFrame:
    """Entries and relevant ones of a rolled-up corpus."""
    return rolled.agg(F.count("*").alias("total_entries"), F.count_if("relevant").alias("total_relevant"), F.count_if(F.col("quelle") == "aggregiert").alias("merged"))


def gold_blocks(reports: DataFrame, visited: DataFrame, gold: DataFrame) -> DataFrame:
    """Per run (scenario, mode, harvest_rate) whether its scenario has a gold corpus, recall and F1 against it, and the corpus' size.

    visited: scenario, mode, url; gold: scenario, url, relevant. Without relevant urls everything is 0.
    """
    wanted = gold.where("relevant").select("scenario", compare_key("url").alias("key")).distinct()
    totals = wanted.groupBy("scenario").agg(F.count("*").alias("total"))
    seen = visited.select("scenario", "mode", compare_key("url").alias("key")).distinct()
    hits = seen.join(wanted, ["scenario", "key"]).groupBy("scenario", "mode").agg(F.count("*").alias("found"))
    rows = reports.join(totals, "scenario", "left").join(hits, ["scenario", "mode"], "left")
    recall = F.round(F.coalesce(F.try_divide(F.coalesce("found", F.lit(0)), "total"), F.lit(0.0)), 4)
    f1 = F.round(F.coalesce(F.try_divide(2 * F.col("harvest_rate") * F.col("gold_recall"), F.col("harvest_rate") + F.col("gold_recall")), F.lit(0.0)), 4)
    rows = rows.withColumn("gold_recall", recall).withColumn("gold_f1", F.when(F.col("total").isNotNull(), f1).otherwise(0.0))
    return rows.select(*reports.columns, F.col("total").isNotNull().alias("gold_available"), "gold_recall", "gold_f1", F.coalesce("total", F.lit(0)).alias("gold_total"))


def compare_reports(reports: DataFrame) -> DataFrame:
    """Focused against bfs per scenario from gold_blocks() of report(): deltas, improvement, where recall comes from, winner.

    Recall and F1 are those against the gold corpus if there is one, else the report's own.
    """
    names = ["harvest_rate", "avg_relevance_score", "recall", "f1_score", "gold_recall", "gold_f1", "gold_available"]
    side = lambda c, m: F.max(F.when(F.col("mode") == m, F.col(c))).alias(f"{c}_{m}")
    both = reports.groupBy("scenario").agg(*[side(c, m) for c in names for m in ("focused", "bfs")])
    gold = F.col("gold_available_focused") & F.col("gold_available_bfs")
    delta = lambda c: F.round(F.col(f"{c}_focused") - F.col(f"{c}_bfs"), 4)
    gain = F.when(F.col("harvest_rate_bfs") > 0, F.round((F.col("harvest_rate_focused") - F.col("harvest_rate_bfs")) / F.col("harvest_rate_bfs") * 100, 2)).otherwise(0.0)
    return both.select(
        "scenario", delta("harvest_rate").alias("harvest_rate_delta"), gain.alias("improvement"), F.when(gold, delta("gold_recall")).otherwise(delta("recall")).alias("recall_delta"),
        F.when(gold, delta("gold_f1")).otherwise(delta("f1_score")).alias("f1_delta"), F.when(gold, "goldstandard").otherwise("reference_corpus_size_approx").alias("recall_source"),
        delta("avg_relevance_score").alias("score_delta"), (F.col("harvest_rate_focused") > F.col("harvest_rate_bfs")).alias("focused_wins"),
    )


def metric_table(reports: DataFrame) -> DataFrame:
    """Per scenario and metric of report() the values of focused and bfs and their difference (0 for counts and F1, minus the rate's for irrelevance)."""
    metrics = {"harvest_rate": "Harvest Rate", "irrelevance_ratio": "Irrelevance Ratio", "avg_relevance_score": "Avg Score", "total_crawled": "Total Crawled", "total_relevant": "Total Relevant", "f1_score": "F1-Score"}
    rows = reports.select("scenario", "mode", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(["scenario", "mode"], list(metrics), "m", "v")
    both = rows.groupBy("scenario", "m").agg(*[F.max(F.when(F.col("mode") == k, F.col("v"))).alias(k) for k in ("focused", "bfs")])
    rates = rows.where("m = 'harvest_rate'").groupBy("scenario").agg(F.round(F.sum(F.when(F.col("mode") == "focused", F.col("v")).otherwise(-F.col("v"))), 4).alias("d"))
    delta = F.when(F.col("m") == "harvest_rate", F.col("d")).when(F.col("m") == "irrelevance_ratio", -F.col("d")).when(F.col("m") == "avg_relevance_score", F.round(F.col("focused") - F.col("bfs"), 4)).otherwise(0.0)
    names = F.create_map(*[F.lit(x) for kv in metrics.items() for x in kv])
    return both.join(rates, "scenario").select("scenario", names[F.col("m")].alias("metrik"), "focused", "bfs", delta.alias("delta"))


def _grams(text: str, size: int) -> Column:
    """The different pieces of so many characters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(F.col(text), i, F.lit(size))))


def contained_in(needles: DataFrame, texts: DataFrame, size: int = 4) -> DataFrame:
    """Needle, text of every pair of rows of needles (needle) and texts (text) where the text contains the needle.

    A needle is looked for only in texts that hold its rarest piece of `size` characters: texts are split into pieces, which are
    counted, and each needle takes the one with the fewest texts. Shorter needles are their own piece and meet texts' pieces of
    their length, which are made only if there are such needles. Nothing is broadcast by order and no pair is tried without a
    piece in common. Null rows meet nothing; an empty needle is in every text; equal rows count once.
    """
    needles, texts = needles.select("needle").where("needle is not null").distinct(), texts.select("text").where("text is not null").distinct()
    lengths = [r[0] for r in needles.select(F.least(F.length("needle"), F.lit(size))).distinct().collect()]  # at most size + 1 numbers
    found = []
    for n in lengths:
        mine = needles.where(F.least(F.length("needle"), F.lit(size)) == n)
        if not n:
            found.append(texts.select(F.lit("").alias("needle"), "text"))
            continue
        pieces = texts.where(F.length("text") >= n).select("text", F.explode(_grams("text", n)).alias("piece"))
        if n < size:
            found.append(pieces.join(mine.withColumnRenamed("needle", "piece"), "piece").select(F.col("piece").alias("needle"), "text"))
            continue
        counts = pieces.groupBy("piece").agg(F.count("*").alias("n"))
        asked = mine.select("needle", F.explode(_grams("needle", n)).alias("piece")).join(counts, "piece", "left")
        rarest = asked.groupBy("needle").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece"))
        found.append(pieces.join(rarest, "piece").where(F.contains("text", "needle")).select("needle", "text"))
    out = needles.select("needle", F.col("needle").alias("text")).limit(0)
    for one in found:
        out = out.unionByName(one)
    return out


def domain_mismatch(domains: DataFrame, hosts: DataFrame) -> DataFrame:
    """Per domain whether no host contains it or is contained in it; any number of either."""
    d, h = domains.select(F.col("domain").alias("needle")), hosts.select(F.col("host").alias("text"))
    holds = contained_in(d, h).select(F.col("needle").alias("domain"))
    held = contained_in(h.withColumnRenamed("text", "needle"), d.withColumnRenamed("needle", "text")).select(F.col("text").alias("domain"))
    met = holds.union(held).distinct().withColumn("met", F.lit(True))
    return domains.join(met, "domain", "left").select("domain", F.col("met").isNull().alias("mismatch"))


def compare_runs(runs: DataFrame) -> DataFrame:
    """Focused and bfs of each scenario side by side; improvement in percent (0 for a zero baseline)."""
    good, mode = F.count_if("is_relevant"), F.col("mode")
    side = lambda m: F.coalesce(F.try_divide(F.count_if(F.col("is_relevant") & (mode == m)), F.count_if(mode == m)), F.lit(0.0))
    score = lambda m: F.coalesce(F.avg(F.when(mode == m, F.col("score"))), F.lit(0.0))
    out = runs.groupBy("scenario").agg(side("focused").alias("hf"), side("bfs").alias("hb"), score("focused").alias("sf"), score("bfs").alias("sb"), good.alias("relevant"))
    gain = F.when(F.col("hb") > 0, (F.col("hf") - F.col("hb")) / F.col("hb") * 100).otherwise(0.0)
    return out.select("scenario", F.round("hf", 4).alias("hr_focused"), F.round("hb", 4).alias("hr_bfs"), F.round(F.col("hf") - F.col("hb"), 4).alias("delta_hr"), F.round(F.col("sf") - F.col("sb"), 4).alias("delta_score"), F.round(gain, 2).alias("improvement"), F.when(F.col("hf") > F.col("hb"), "focused").otherwise("bfs").alias("winner"))


def comparison_table(compared: DataFrame) -> DataFrame:
    """One row per scenario and metric."""
    metrics = ["hr_focused", "hr_bfs", "delta_hr", "delta_score", "improvement"]
    return compared.unpivot(["scenario"], metrics, "metrik", "wert")
