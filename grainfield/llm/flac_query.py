"""Query op7: every document's bytes written as a table of FLAC streams, and read back from it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfield.llm.flac import flac_decode, flac_encode
from grainfield.llm.shared import written


def op7_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = written(flac_encode(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media", "zstd")
    back = flac_decode(media, ["n_bytes"])
    tail = F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32")
    return back.select("doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), tail, "media_bytes", "media_sha256", "feature")


QUERIES = {"op7_flac": op7_flac}
ORACLE_SQL: dict[str, str] = {}
