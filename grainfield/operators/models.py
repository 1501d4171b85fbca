"""Comparison of models: scores of their findings against gold lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainfield.functions.answers import quality_issues
from grainfield.functions.text import overlap_f1


def _issues(found: DataFrame, today: str) -> DataFrame:
    return found.withColumn("issues", quality_issues(F.col("massnahme"), F.col("adresse"), F.col("start"), F.col("ende"), F.col("quelle_url"), today))


def scored_examples(golden: DataFrame, found: DataFrame, today: str) -> DataFrame:
    """Examples (id, modell, latency, gold array of titles) with f1 (3 decimals), found and valid, from findings (id, ...)."""
    mine = _issues(found, today).groupBy("id").agg(F.collect_list("massnahme").alias("titles"), F.count("*").alias("found"), F.count_if(F.size("issues") == 0).alias("valid"))
    rows = golden.join(mine, "id", "left").withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))
    return rows.select("id", "modell", "latency", F.round(overlap_f1(F.col("titles"), F.col("gold")), 3).alias("f1"), F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("valid", F.lit(0)).alias("valid"))


def model_summary(scored: DataFrame) -> DataFrame:
    """Per model the means of F1, findings, valid findings and latency."""
    return scored.groupBy("modell").agg(F.count("*").alias("n"), F.round(F.avg("f1"), 3).alias("mean_f1"), F.round(F.avg("found"), 1).alias("mean_found"), F.round(F.avg("valid"), 1).alias("mean_valid"), F.round(F.avg("latency"), 1).alias("mean_latency"))


def top_issues(golden: DataFrame, found: DataFrame, today: str, most: int) -> DataFrame:
    """Per model its most frequent faults."""
    rows = _issues(found, today).select("id", F.explode("issues").alias("issue")).join(golden.select("id", "modell"), "id")
    counts = rows.groupBy("modell", "issue").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("modell").orderBy(F.desc("n"), "issue"))
    return counts.withColumn("r", place).where(F.col("r") <= most).select("modell", "issue", "n")
