"""Writers of the engine's files; each returns nothing and is safe to run again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Log levels from least to most.
LEVELS = ["DEBUG", "INFO", "OK", "WARN", "ERROR", "AUDIT"]


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, replacing what was there (or added to it)."""
    df.write.mode(mode).json(path)


def write_json_array(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A short table (results of runs) as one JSON array in its order of columns; a longer one is refused, not cut."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"over {most} rows: write_json() writes them as lines")
    array = F.to_json(F.array_sort(F.collect_list(F.struct("*"))), {"ignoreNullFields": "false"})
    df.agg(array.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_comparison(table: DataFrame, path: str) -> None:
    """Long comparison table as CSV with header."""
    table.write.mode("overwrite").csv(path, header=True)


def project_export(records: DataFrame, domain: str) -> DataFrame:
    """One row with total and counts by category and place; the records themselves go out as rows beside it."""
    rows = records.select("kategorie", F.coalesce("ort", F.lit("(unbekannt)")).alias("ort"))
    sums = rows.groupingSets([["kategorie"], ["ort"]], "kategorie", "ort").agg(F.count("*").alias("n"))
    entry = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(c, "n")))))
    return sums.agg(F.sum(F.when(F.col("ort").isNull(), F.col("n"))).alias("total"), entry("kategorie").alias("by_kategorie"), entry("ort").alias("by_ort")).withColumn("domain", F.lit(domain))


def write_project(records: DataFrame, domain: str, path: str) -> None:
    """The summary of project_export() and, beside it, the records as JSON lines, whatever their number."""
    project_export(records, domain).write.mode("overwrite").json(f"{path}/summary")
    records.write.mode("overwrite").json(f"{path}/records")


def keyword_text(keywords: Column | str, most: int = 10) -> Column:
    """the first keywords between bars, with semicolons for commas."""
    return F.replace(F.array_join(F.slice(keywords, 1, most), "|"), F.lit(","), F.lit(";"))


def gold_export(entries: DataFrame) -> DataFrame:
    """Per domain one row with its entries, ordered by url; a corpus is what people annotate, so a domain's entries fit into a row."""
    item = F.struct("url", "relevant", "kategorie", "notiz")
    return entries.groupBy("domain").agg(F.count("*").alias("total_entries"), F.count_if("relevant").alias("total_relevant"), F.array_sort(F.collect_list(item)).alias("entries"))


def seed_snapshot(config: DataFrame, selected: DataFrame) -> DataFrame:
    """The configuration with the selected domains (at most its max_domains) and their number."""
    chosen = selected.agg(F.array_sort(F.collect_list("ags")).alias("domains"), F.count("*").alias("total"))
    return config.crossJoin(F.broadcast(chosen))


def write_split(pairs: DataFrame, path: str) -> None:
    """One folder per part."""
    pairs.write.mode("overwrite").partitionBy("part").json(path)


def write_by_place_and_model(results: DataFrame, path: str) -> None:
    """K17."""
    results.write.mode("overwrite").partitionBy("ort_slug", "modell").json(path)


def level_at_least(least: str):
    """P25: by place in the order of levels; unknown levels pass."""
    order = F.array(*[F.lit(x) for x in LEVELS])
    return (F.array_position(order, F.col("level")) == 0) | (F.array_position(order, F.col("level")) >= LEVELS.index(least) + 1)


def write_channels(events: DataFrame, path: str, least: str = "INFO") -> None:
    """All events of a level on as JSON, relevance as CSV, privacy always, evaluation as JSON."""
    events.where(level_at_least(least)).write.mode("overwrite").json(f"{path}/all")
    keywords = F.replace(F.col("extra")["keywords"], F.lit(","), F.lit(";"))
    events.where("event = 'RELEVANCE'").select("ts", F.col("extra")["url"].alias("url"), F.col("extra")["score"].alias("score"), keywords.alias("matched_keywords")).write.mode("overwrite").csv(f"{path}/relevance", header=True)
    events.where("event = 'PRIVACY'").write.mode("overwrite").json(f"{path}/privacy")
    events.where("event = 'EVALUATION'").write.mode("overwrite").json(f"{path}/evaluation")


def skipped_lines(log: DataFrame, path: str) -> None:
    """One text line per skipped url."""
    log.select(F.concat_ws("\t", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "url", "reason").alias("value")).write.mode("overwrite").text(path)


def insert_children(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children (version, ...) with the id of their parent by its natural key."""
    return children.join(parents.select(F.col("id").alias("changelog_id"), "version"), "version").drop("version")
