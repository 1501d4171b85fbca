"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainfield.llm.shared import written


def _with_least(rows: DataFrame, total: int) -> DataFrame:
    """Rows (u, v) with m, the least of u and its v's. Keys u with over a five-thousandth of all rows (and at least 64) are
    at most 5,000: their m is broadcast, so that their rows stay where they are."""
    hot = max(64, total // 5000)
    heavy = F.broadcast(rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).where(F.col("n") > hot).drop("n"))
    light = rows.join(heavy.select("u"), "u", "left_anti").withColumn("m", F.min("v").over(Window.partitionBy("u")))
    return light.unionByName(rows.join(heavy, "u")).withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = _with_least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), total)
    ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return down.select(F.inline(ends)).where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge, root the least node of its component.

    Rows with a null end and loops are left out; repeated edges count once; no edge, no row; other columns are left out,
    whatever their names. Each half of a round is written to the shared folder, so rounds don't pile up in the lineage. The
    rounds end when every node has one edge, to a node that has none of its own.
    """
    links = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    while total := links.count():
        large = written(_large_star(links, total), "large-star")
        links = written(_small_star(large, large.count()), "small-star")
        nodes, rows = links.agg(F.count_distinct("u"), F.count("*")).first()
        if nodes == rows and links.join(links.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
