"""Query op4: all documents mixed by source."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfield.llm.mixing import length_tilt, mix, sized_documents

WEIGHTS = (5, 2, 1)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = sized_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    mixed = mix(sized.withColumn("tilt", length_tilt("size")), WEIGHTS, ["id", "text_hash"], tilt="tilt")
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op4_mixing": op4_mixing}
ORACLE_SQL: dict[str, str] = {}
