"""A hierarchical index of bit codes in Gray order, for searches by Hamming distance.

Codes are sorted by Gray rank, so that neighbours share many bits. FANOUT neighbours make a node that keeps the bits they
share, as a mask and a pattern; FANOUT nodes make an upper node. A search carries the differences found on the way down:
a node adds only those of its mask that its parent's mask did not hold, and a whole group is left as soon as the sum is
over the radius.

Across Spark, the aligned Gray intervals (that is, code prefixes of varying length) that hold at most a given number of
codes are cells. A code is at home in one cell and visits the later cells whose prefix is within the radius; each cell
is one task's index. Cells are cut from a bounded sample, deeper where codes are dense, and visitors of a crowded cell
are dealt over copies of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfield.llm.shared import written

FANOUT = 16
#: Codes at home in a cell, and visitors of one copy of a cell.
HOME, VISITORS = 8192, 65536
#: Codes that the driver may see to cut the cells.
SAMPLE = 1 << 17
_CHUNK = 4096
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence."""
    rank = codes.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """The index of some codes; where masks are given, bits outside them match anything."""

    def __init__(self, codes: np.ndarray, masks: np.ndarray | None = None):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        bits = codes[self.order].astype(np.uint64)
        mask = np.full(len(bits), _ALL) if masks is None else masks[self.order].astype(np.uint64)
        self.levels = [(bits & mask, mask)]
        while len(bits) > FANOUT:
            head = np.arange(0, len(bits), FANOUT)
            first = np.repeat(bits[head], np.diff(np.append(head, len(bits))))
            shared = np.bitwise_and.reduceat(mask, head) & ~np.bitwise_or.reduceat(bits ^ first, head)
            bits, mask = bits[head] & shared, shared
            self.levels.append((bits, mask))

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query number, code number) at most radius apart, in blocks."""
        for at in range(0, len(queries), _CHUNK):
            block = queries[at : at + _CHUNK].astype(np.uint64)
            bits, mask = self.levels[-1]
            query = np.repeat(np.arange(len(block)), len(bits))
            node = np.tile(np.arange(len(bits)), len(block))
            apart = np.zeros(len(node), np.uint8)
            known = np.zeros(len(node), np.uint64)
            for level in range(len(self.levels) - 1, -1, -1):
                bits, mask = self.levels[level]
                apart = apart + np.bitwise_count((block[query] ^ bits[node]) & mask[node] & ~known)
                near = np.flatnonzero(apart <= radius)
                query, node, apart = query[near], node[near], apart[near]
                if level:
                    known = np.repeat(mask[node], FANOUT)
                    query, apart = np.repeat(query, FANOUT), np.repeat(apart, FANOUT)
                    node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    there = node < len(self.levels[level - 1][0])
                    query, node, apart, known = query[there], node[there], apart[there], known[there]
            yield query + at, self.order[node]


class Forest:
    """Union-find that keeps the edges which joined two trees."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.root[x]
            if (up == self.root[up]).all():
                return up
            self.root[x] = self.root[up]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        ra, rb = self.find(a), self.find(b)
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if len(a):
            key = np.minimum(ra, rb).astype(np.int64) * len(self.root) + np.maximum(ra, rb)
            _, one = np.unique(key, return_index=True)
            root = self.root
            for x, y in zip(a[one].tolist(), b[one].tolist()):
                p, q = x, y
                while root[p] != p:
                    p = root[p]
                while root[q] != q:
                    q = root[q]
                if p != q:
                    root[max(p, q)] = min(p, q)
                    self.edges.append((x, y))


def plan_cells(codes: DataFrame, column: str, count: int, home: int = HOME, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Prefixes (left-aligned) and depths of cells that tile all codes, in code order, each of about `home` codes or less.

    They are cut from a sample by hash of about `sample` codes at most, which is all that the driver sees (8 bytes each); with
    fewer codes than that the sample is all of them. The codes are distinct.
    """
    every = max(1, -(-count // sample))
    picked = codes if every == 1 else codes.where(F.pmod(F.xxhash64(column), F.lit(every)) == 0)
    seen = np.sort(picked.select(column).toPandas()[column].to_numpy(np.int64).view(np.uint64)) if count else np.empty(0, np.uint64)
    most = max(1, home // every, 8 * (every > 1))
    cells: list[tuple[int, int]] = []
    open_ = [(0, 0, 0, len(seen))]
    while open_:
        prefix, depth, low, high = open_.pop()
        if high - low <= most or depth == 64:
            cells.append((prefix, depth))
            continue
        half = prefix | 1 << 63 - depth
        middle = low + int(np.searchsorted(seen[low:high], np.uint64(half)))
        open_ += [(half, depth + 1, middle, high), (prefix, depth + 1, low, middle)]
    return np.array([p for p, _ in cells], np.uint64), np.array([d for _, d in cells], np.int64)


def near_forest(codes: DataFrame, column: str, radius: int, home: int = HOME, visitors: int = VISITORS) -> DataFrame:
    """Links (a, b) between the distinct 64-bit codes of a column, as a forest per cell.

    Two codes are connected by these links if and only if they are connected by steps of at most `radius` bits. A cell
    gives fewer links than it has codes, however many pairs are near. Nulls are left out.
    """
    codes = codes.select(column).where(F.col(column).isNotNull())
    prefix, depth = plan_cells(codes, column, codes.count(), home)
    mask = np.array([(1 << 64) - (1 << 64 - d) if d else 0 for d in depth.tolist()], np.uint64)

    def route(frames):
        index = GrayIndex(prefix, mask)
        for frame in frames:
            code = frame[column].to_numpy(np.int64)
            own = np.searchsorted(prefix, code.view(np.uint64), side="right") - 1
            for query, cell in index.within(code.view(np.uint64), radius):
                keep = cell >= own[query]
                query, cell = query[keep], cell[keep]
                yield pd.DataFrame({"cell": cell, "home": cell == own[query], "code": code[query]})

    routed = written(codes.mapInPandas(route, "cell int, home boolean, code long"), "routed")
    visiting = routed.where("not home").groupBy("cell").count().where(F.col("count") > visitors)
    copies = [(r[0], -(-r[1] // visitors)) for r in visiting.collect()]  # at most a row per cell
    crowded = codes.sparkSession.createDataFrame(copies, "cell int, copies int")
    dealt = routed.join(F.broadcast(crowded), "cell", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    salts = F.when(F.col("home"), F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array(F.pmod(F.xxhash64("code"), F.col("copies")).cast("int")))
    dealt = dealt.select("cell", "home", "code", F.explode(salts).alias("salt"))

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        at_home = frame["home"].to_numpy()
        own = frame["code"].to_numpy(np.int64)[at_home]
        code = np.concatenate((own, frame["code"].to_numpy(np.int64)[~at_home]))
        forest = Forest(len(code))
        if len(own):
            index = GrayIndex(own.view(np.uint64))
            for query, item in index.within(code.view(np.uint64), radius):
                forest.join(query, item)
        edges = np.array(forest.edges, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": code[edges[:, 0]], "b": code[edges[:, 1]]})

    return dealt.groupBy("cell", "salt").applyInPandas(link, "a long, b long")
