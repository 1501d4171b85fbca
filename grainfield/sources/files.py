"""Readers of the engine's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfield import schemas

CATEGORIES = ["bauen", "verwaltung", "wirtschaft", "infrastruktur", "aktuelles", ""]


def master_targets(spark: SparkSession, path: str) -> DataFrame:
    """Semicolons, all columns text, empty is null; keys keep their leading zeros."""
    rows = spark.read.csv(path, sep=";", header=True, inferSchema=False, nullValue="", encoding="UTF-8")
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """S3: header and values trimmed, rows without an http url dropped, an unreadable population is 0."""
    rows = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8")
    rows = rows.toDF(*[c.lstrip("﻿").strip().lower() for c in rows.columns])
    rows = rows.select(*[F.trim(c).alias(c) for c in rows.columns])
    return rows.withColumn("einwohner", F.coalesce(F.col("einwohner").try_cast("int"), F.lit(0))).where(F.col("url").startswith("http"))


def gold_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entries with a known category, and the rejected others."""
    rows = spark.read.schema(schemas.GOLD).json(path, multiLine=True).select("domain", "annotator", F.inline("entries"))
    known = F.coalesce("kategorie", F.lit("")).isin(CATEGORIES)
    return rows.where(known), rows.where(~known)


def scenarios(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Scenarios with all required fields, and the others with what they lack."""
    rows = spark.read.schema(schemas.SCENARIO).json(path, multiLine=True)
    need = ["label", "seed_url", "max_pages"]
    missing = F.array_except(F.array(*[F.lit(c) for c in need]), F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in need])))
    rows = rows.withColumn("missing", missing)
    return rows.where(F.size("missing") == 0).drop("missing"), rows.where(F.size("missing") > 0)


def seed_config(spark: SparkSession, path: str) -> DataFrame:
    """With defaults."""
    rows = spark.read.schema(schemas.SEED_CONFIG).json(path, multiLine=True)
    return rows.withColumns({"random_seed": F.coalesce("random_seed", F.lit(42)), "min_einwohner": F.coalesce("min_einwohner", F.lit(0)), "max_domains": F.coalesce("max_domains", F.lit(10)), "default_max_pages": F.coalesce("default_max_pages", F.lit(50))})


def model_results(spark: SparkSession, folder: str, model: str) -> DataFrame:
    """Flat files *_<model>.json and nested <place>/<model>/normalized.json, with their file name; not de-duplicated."""
    flat = spark.read.schema(schemas.MODEL_RESULT).option("pathGlobFilter", f"*_{model}.json").json(folder, multiLine=True).withColumn("file", F.input_file_name())
    nested = spark.read.schema(schemas.MODEL_RESULT).option("pathGlobFilter", "normalized.json").option("recursiveFileLookup", True).json(folder, multiLine=True).withColumn("file", F.input_file_name())
    return flat.unionByName(nested.where(F.contains("file", F.lit(f"/{model}/"))))


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schemas.PAIRS).json(path).where("instruction is not null or input is not null or output is not null")


def parse_events(lines: DataFrame) -> DataFrame:
    """Ts, level, event, message, and the free keys as a map; for a batch or a stream of text lines."""
    head = F.from_json("value", schemas.EVENT)
    tail = F.map_filter(F.from_json("value", "map<string,string>"), lambda k, v: ~k.isin("ts", "level", "event", "message"))
    return lines.select(head.alias("h"), tail.alias("extra")).select("h.*", "extra").where("ts is not null")


def events(spark: SparkSession, path: str) -> DataFrame:
    return parse_events(spark.read.text(path))


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    return parse_events(spark.readStream.text(path))


def targets_or_inline(spark: SparkSession, table: DataFrame, forced: list[tuple[str, str]] | None) -> DataFrame:
    """A short inline list (ags, url) in place of the table, if one is given."""
    return spark.createDataFrame(forced, "ags string, url string") if forced else table.select("ags", "url")
