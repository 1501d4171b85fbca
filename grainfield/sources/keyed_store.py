"""Keyed tables as files in buckets of their key, of which a write replaces only those it touches.

The folder holds `data`, a folder per write with a folder per bucket, and `manifest`, a small table per version that names each
bucket's folder. A write reads the buckets its keys fall into, writes them anew beside the old ones and then the next manifest:
one file, so it is there or not. Until then readers see the version before, and after a failure nothing has changed. A second
writer of the same version fails, as its manifest is there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "bucket int, folder string, buckets int, key array<string>, schema string"


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list]:
    every = spark.read.schema(f"{MANIFEST}, version long").parquet(f"{path}/manifest")
    version = every.agg(F.max("version")).first()[0] if version is None else version
    return version, every.where(F.col("version") == version).collect()  # as many rows as buckets


def _write(rows: DataFrame, path: str, key: list[str], buckets: int) -> dict[int, str]:
    """Writes the rows by bucket; the folders of the buckets that have some."""
    folder = f"data/{uuid.uuid4().hex}"
    keyed = rows.withColumn("_bucket", _bucket(key, buckets))
    keyed.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/{folder}")
    found = rows.sparkSession.read.schema(keyed.schema).parquet(f"{path}/{folder}").select("_bucket").distinct().collect()
    return {r[0]: f"{folder}/_bucket={r[0]}" for r in found}


def _commit(spark: SparkSession, path: str, version: int, folders: dict[int, str], buckets: int, key: list[str], schema: str) -> None:
    rows = [(b, f, buckets, key, schema) for b, f in sorted(folders.items())] or [(None, None, buckets, key, schema)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("error").parquet(f"{path}/manifest/version={version}")


def create_store(rows: DataFrame, path: str, key: list[str], buckets: int = 64) -> None:
    """A new store of the rows. Take so many buckets that one fits into a task's share of memory several times over."""
    _commit(rows.sparkSession, path, 0, _write(rows, path, key, buckets), buckets, key, rows.schema.json())


def _read(spark: SparkSession, path: str, manifest: list, only: set[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(manifest[0].schema))
    folders = [f"{path}/{r.folder}" for r in manifest if r.folder is not None and (only is None or r.bucket in only)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_store(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of the newest version, or of an earlier one."""
    return _read(spark, path, _manifest(spark, path, version)[1])


def merge_store(batch: DataFrame, path: str, change: Callable[[DataFrame, DataFrame], DataFrame]) -> set[int]:
    """The store after change(rows, batch), for the buckets the batch's keys fall into; returns those.

    change gives the rows afterwards and looks at equal keys alone (upsert, apply_updates, the rows and insert_if_absent), so the
    other buckets keep their files. The batch needs the key's columns; an empty one changes nothing.
    """
    spark = batch.sparkSession
    version, manifest = _manifest(spark, path)
    buckets, key = manifest[0].buckets, list(manifest[0].key)
    touched = {r[0] for r in batch.select(_bucket(key, buckets)).distinct().collect()}
    if touched:
        old = _read(spark, path, manifest, touched)
        written = _write(change(old, batch).select(*old.columns), path, key, buckets)
        folders = {r.bucket: r.folder for r in manifest if r.folder is not None and r.bucket not in touched}
        _commit(spark, path, version + 1, folders | written, buckets, key, manifest[0].schema)
    return touched
