"""Query op6: main text of every page."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfield.llm.html_cut import extract_text


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op6_main_text": op6_main_text}
ORACLE_SQL: dict[str, str] = {}
