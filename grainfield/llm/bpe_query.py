"""Query op1: every whole document encoded and decoded."""

from pyspark.sql import DataFrame, SparkSession

from grainfield.llm.bpe import bpe_round_trip


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op1_bpe": op1_bpe}
ORACLE_SQL: dict[str, str] = {}
