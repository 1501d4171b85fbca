"""Query op2: every document encoded into token files and read back."""

from pyspark.sql import DataFrame, SparkSession

from grainfield.llm.dac import documents_of, read_token_files, write_token_files
from grainfield.llm.shared import new_path

END_ID = 2


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return documents_of(read_token_files(spark, folder))


QUERIES = {"op2_token_files": op2_token_files}
ORACLE_SQL: dict[str, str] = {}
