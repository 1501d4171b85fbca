"""Links between the members of groups, exact for groups of any size, with bounded tasks.

A group of up to a given size is compared in one task. A larger one is cut into blocks. First every block is compared
within itself and with HUBS members of the whole group, which takes work in proportion to the group. The links found so
far make classes; all pairs within a class are connected already, so only the members outside a group's largest class are
then compared with the whole group, block by block. What a task holds is two blocks and the hubs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfield.llm.components import connected_components
from grainfield.llm.gray_index import Forest
from grainfield.llm.shared import join_small, written

HUBS = 24
#: The root of a group's largest class, all of which is connected; keys are not negative.
LARGEST = -1


def start_forest(rows: pd.DataFrame) -> Forest:
    """A forest of these rows in which those of one block that are connected already (same root) are one tree."""
    forest = Forest(len(rows))
    if len(rows):
        _, first, same = np.unique(rows[["node", "block", "root"]].to_numpy(np.int64), axis=0, return_index=True, return_inverse=True)
        forest.root = first[same.ravel()]
    return forest


def still_asking(forest: Forest, members: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
    """The asking members of a block that must meet all others of it: those outside the largest class, or, where all ask,
    outside the largest tree. Where some don't ask and none is of the largest class, that is all that ask."""
    ask, tree = rows["ask"].to_numpy(bool)[members], forest.find(members)
    largest = rows["root"].to_numpy()[members] == LARGEST
    if ask.all():
        names, count = np.unique(tree, return_counts=True)
        left = names[count.argmax()]
    elif largest.any():
        left = tree[largest.argmax()]
    else:
        return members[ask]
    return members[(tree != left) & ask]


def whole_blocks(frames: Iterator[pd.DataFrame], link: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of frames in order of (node, block), with link() called on rows of whole blocks."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        held.append(frame)
        first, last = (int(held[0]["node"].iloc[0]), int(held[0]["block"].iloc[0])), (int(frame["node"].iloc[-1]), int(frame["block"].iloc[-1]))
        if first == last:
            continue
        whole = pd.concat(held, ignore_index=True)
        open_ = ((whole["node"] == last[0]) & (whole["block"] == last[1])).to_numpy()
        yield link(whole[~open_])
        held = [whole[open_]]
    if held:
        yield link(pd.concat(held, ignore_index=True))


def group_links(members: DataFrame, crowded: DataFrame, link: Callable[[pd.DataFrame], pd.DataFrame], most: int) -> DataFrame:
    """Links (a, b) between keys that connect what link() connects within each node.

    members: node (the group, long), key (long, once in a group) and what link() needs. crowded: a written table of
    (node, blocks) of the groups that don't fit into one task. link() gets whole blocks, with block, root and ask added:
    it gives links between rows of one block, of which at least one asks, until every such pair that is near is connected;
    rows of one root are connected already. Keys are not negative, as root LARGEST means the largest class. Members with a
    null node or key are not expected; no members, no links.
    """
    names = [c for c in members.columns if c != "node"]
    kinds = ", ".join(f"{k} {members.schema['key'].dataType.simpleString()}" for k in "ab")

    def run(rows: DataFrame) -> DataFrame:
        dealt = rows.repartition("node", "block").sortWithinPartitions("node", "block")
        return dealt.mapInPandas(lambda frames: whole_blocks(frames, link), kinds)

    alone = F.lit(True).alias("ask")
    if crowded.isEmpty():
        dealt = members.repartition("node").sortWithinPartitions("node").withColumns({"block": F.lit(0).cast("long"), "root": F.col("key"), "ask": F.lit(True)})
        return dealt.mapInPandas(lambda frames: whole_blocks(frames, link), kinds)
    block = F.pmod(F.xxhash64("key"), F.col("blocks"))
    placed = join_small(members, crowded, "node", "left")
    once = placed.select("node", F.coalesce(block, F.lit(0)).alias("block"), *names, F.col("key").alias("root"), alone)
    large = join_small(members, crowded, "node")
    picked = large.groupBy("node", F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(HUBS)).alias("_h")).agg(F.min("key").alias("key")).select("node", "key")
    hubs = large.join(picked, ["node", "key"]).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where(F.col("other") != block)
    first = written(run(once.unionByName(hubs.select("node", F.col("other").alias("block"), *names, F.col("key").alias("root"), alone))), "links")

    roots = connected_components(first).withColumnRenamed("node", "key")
    classed = written(large.select("node", "blocks", "key").join(roots, "key", "left").select("node", "blocks", "key", F.coalesce("root", "key").alias("root")), "classed")
    sizes = classed.groupBy("node", "root").agg(F.count("*").alias("n"))
    biggest = sizes.groupBy("node").agg(F.max_by("root", F.struct("n", "root")).alias("big"), (F.sum("n") - F.max("n")).alias("rest")).where("rest > 0")
    biggest = written(biggest.select("node", "big", F.ceil(F.col("rest") / most).cast("long").alias("turns")), "rest")
    if biggest.isEmpty():
        return first
    asked = join_small(classed, biggest, "node").withColumn("ask", F.col("root") != F.col("big")).withColumn("turn", F.pmod(F.xxhash64(F.lit(2), "key"), F.col("turns")))
    others = asked.withColumn("block", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1), lambda t: t * F.col("blocks") + block))).withColumn("ask", F.lit(False))
    asking = asked.where("ask").withColumn("block", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: F.col("turn") * F.col("blocks") + b)))
    rows = asking.unionByName(others.where("root = big or turn <> floor(block / blocks)")).select("node", "key", "block", F.when(F.col("root") == F.col("big"), LARGEST).otherwise(F.col("root")).alias("root"), "ask")
    second = run(large.select("node", *names).join(rows, ["node", "key"]).select("node", "block", *names, "root", "ask"))
    return first.unionByName(second)
