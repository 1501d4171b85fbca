"""The folder that driver and executors share, tables in it, and joins that no hot key can slow down."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

#: Tables of at most so many rows of a few numbers (some 10 MB) are broadcast.
SMALL = 200_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, with a folder of this application's own; on one machine (tests) it may be unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='grainfield-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The same rows read back from a table in the shared folder: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _held(kind: DataType, wanted: tuple[type, ...]) -> bool:
    """Whether a type is one of these, or holds one at any depth."""
    inner = [f.dataType for f in kind.fields] if isinstance(kind, StructType) else [kind.elementType] if isinstance(kind, ArrayType) else [kind.keyType, kind.valueType] if isinstance(kind, MapType) else []
    return isinstance(kind, wanted) or any(_held(k, wanted) for k in inner)


def row_keys(df: DataFrame, names: tuple[str, str] = ("k0", "k1")) -> list[Column]:
    """Two 64-bit hashes of a row's columns, alike for equal rows; columns that hold maps or variants, which Spark doesn't hash, go in as JSON."""
    columns = [F.to_json(F.struct(F.col(f"`{f.name}`").alias("v"))) if _held(f.dataType, (MapType, VariantType)) else F.col(f"`{f.name}`") for f in df.schema.fields]
    return [F.xxhash64(F.lit(i), *columns).alias(name) for i, name in enumerate(names)]


def join_small(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join with a written table that is mostly small: broadcast if it has at most SMALL rows, else shuffled."""
    return rows.join(F.broadcast(table) if table.count() <= SMALL else table, key, how)


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Each row with its key's other columns of the table; count is how many of the total rows have the key.

    Keys with over a five-thousandth of all rows (and at least 64) are at most 5,000 and broadcast, so their rows stay
    where they are; the others are shuffled. Both sides should be tables read back or cheap to make, as they are read twice.
    """
    hot = max(64, total // 5000)
    heavy, light = table.where(F.col(count) > hot).drop(count), table.where(F.col(count) <= hot).drop(count)
    known = F.broadcast(heavy)
    return rows.join(known, key).unionByName(rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key))
