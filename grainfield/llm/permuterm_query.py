"""Query op13: spelling variants of the words of all documents."""

from pyspark.sql import DataFrame, SparkSession

from grainfield.llm.permuterm import count_words, spelling_forms

#: One word in so many is damaged, so that there are variants to find.
DAMAGE = 199


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(count_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), damage=DAMAGE))


QUERIES = {"op13_variants": op13_variants}
ORACLE_SQL: dict[str, str] = {}
