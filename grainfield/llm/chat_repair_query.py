"""Query op11: all conversations damaged by a rule, and repaired."""

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfield.llm.chat_repair import repair_conversations, repair_digests


def _fate() -> Column:
    """What happens to a row: 0 dropped, 1 emptied, 2 without its ends of sentences, 3 twice, 4 a user's, else nothing."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after damage; null roles and texts are one space."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), _fate().alias("_fate")).where("_fate <> 0")
    text = F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("_fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = repair_digests(repair_conversations(damaged(rows)))
    lost = rows.groupBy("conv_id").agg(F.max(_fate() != 0).alias("_left")).where("not _left")  # every row dropped
    kind = dict(found.dtypes)
    empty = {c: F.lit({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}.get(c, 0)).cast(kind[c]) for c in found.columns[1:]}
    return found.union(lost.select("conv_id", *[e.alias(c) for c, e in empty.items()]))


QUERIES = {"op11_repair": op11_repair}
ORACLE_SQL: dict[str, str] = {}
