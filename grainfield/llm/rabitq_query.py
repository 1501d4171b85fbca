"""Query op8: the ten nearest of every hundredth vector, among all."""

from pyspark.sql import DataFrame, SparkSession

from grainfield.llm.rabitq import search, valid_vectors


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = valid_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 100 = 0"), k=10)


QUERIES = {"op8_neighbours": op8_neighbours}
ORACLE_SQL: dict[str, str] = {}
