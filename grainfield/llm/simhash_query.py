"""Query op5: fingerprint and near-duplicate class of every document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfield.llm.simhash import simhash_components


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": op5_simhash}
ORACLE_SQL: dict[str, str] = {}
