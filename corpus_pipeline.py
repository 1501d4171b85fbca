"""Corpus pipeline: toxicity, near-duplicates, mixing, encoding. Counted as part of grainfield.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfield.llm.bpe import bpe_round_trip
from grainfield.llm.mixing import length_tilt, mix, word_count
from grainfield.llm.shared import row_keys, written
from grainfield.llm.simhash_dedup import drop_near_duplicates
from grainfield.llm.toxicity import fit_toxicity, score_toxicity

TOXIC, WEIGHTS = 0.3, (5, 2, 1)


def _packed(docs: DataFrame) -> DataFrame:
    """row (the whole row as one struct), text, source, and two hashes of all columns; so no column's name can clash with ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", "source", *row_keys(docs))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold; the model learns from the labels of all documents.

    Null and empty texts have a score, too; repeated rows are judged alike and each stays or goes; without labels of both
    kinds nothing is rejected; an empty table gives an empty one; extra columns stay, whatever their names.
    """
    model = fit_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(_packed(docs).select("row", "text"), model, id_col="row")
    return scored.where(F.col("score") < TOXIC).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones (five-word shingles, similarity 0.8): the one of least doc_id (null last).

    Null, empty and wordless texts are copies of one another; of repeated rows one stays; an empty table gives an empty
    one; extra columns stay, whatever their names.
    """
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as many times as it is taken; longer ones are likelier, the sources' targets hold.

    A null source is a source of its own; rows without words are taken as their source's whole copies; repeated rows are
    ranked by one number and each taken by itself, so their copies are added up; an empty table gives an empty one; extra
    columns stay, whatever their names.
    """
    rows = _packed(docs)
    sized = written(rows.select("k0", "k1", "source", word_count("text").alias("size")), "sizes")
    mixed = mix(sized.withColumn("tilt", length_tilt("size")), WEIGHTS, ["k0", "k1"], tilt="tilt")
    copies = mixed.groupBy("k0", "k1").agg(F.sum("copies").alias("copies"), F.count("*").alias("repeats"))
    copies = written(copies.where("copies > 0"), "copies")
    rows = rows.select("row", "k0", "k1")
    if not copies.where("repeats > 1").isEmpty():  # rows equal in every column become one where they lie, and all copies come from it
        rows = rows.dropDuplicates(["k0", "k1"])
    taken = rows.join(copies, ["k0", "k1"]).withColumn("thousand", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / 1000))))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(1000), F.col("copies") - 1000 * F.col("thousand")).cast("int")))).select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and round trip of every document of the mix; null texts count as empty, repeated rows each have a row, an empty table gives
    an empty one; there are no ties, as every row is taken by itself; extra columns are left out, whatever their names."""
    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("encoding", encoding)]
#: The stages run models, hashes and merges that SQL doesn't express; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
