"""Near-duplicate removal on word shingles: one document of each group stays.

Documents are linked if their sets of different shingles have a similarity (Jaccard) of SIMILARITY or more; this is counted
on the sets themselves. Equal sets are one node from the start. A fingerprint of 4 x 64 bits finds the candidates: two sets
of similarity s have the cosine 2s/(1+s), so a bit differs with probability acos(cosine)/pi, and pairs with at most
DIFFERENCES of the 256 bits are candidates (39 are expected at 0.8, the limit is more than three deviations above).

Candidates: several hierarchies over differently chosen bits. Their upper nodes are cells that share a masked pattern of
`depth` bits; only these travel. A cell has up to 2^CELL members at any number of documents beyond 2^(CELL + DEPTH), and
DEPTH levels below that, so up to there a document is sent the same number of times however many there are. Within a cell of over
WHOLE members lower nodes share further bits, over several choices of them, in the cell's own task; their leaves lie in Gray
order. The numbers of choices follow from the depths so that a pair of similarity 0.8, whose bits differ as the binomial
distribution says, meets with probability RECALL, whatever the size of its groups. Within a lower node every pair is compared
but those that are already connected: in nodes over PAIRS hubs come first, then all that are outside the largest tree meet
all others. A cell gives fewer links than it has members.

Links: the connected candidates are a family, and every pair of candidates lies in one. Within a family every pair of
shingle sets is counted but those already connected by links. Documents without candidates are left alone. Cells over
CROWD members (more where cells are large) and families over FAMILY members or SET_HASHES shingles are worked off in blocks (group_links), with the
same result.

Cases: null and empty texts (and texts without words) have the empty set and are copies of one another; a shorter text is
one shingle; of a group the row with the least id stays (null last), then by a hash of the row, and of rows equal in every
column one; an empty table gives an empty one; all columns of the input come back as they were, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfield.llm.bpe import batches
from grainfield.llm.components import connected_components
from grainfield.llm.gray_index import gray_rank
from grainfield.llm.group_links import HUBS, group_links, start_forest, still_asking
from grainfield.llm.shared import row_keys, written
from grainfield.llm.simhash import majority, shingle_hashes

WORDS, SIMILARITY, DIFFERENCES, RECALL = 5, 0.8, 60, 0.97
#: Least depth of the cells, binary logarithm of their members, recall within one, members of a cell that has no lower nodes.
DEPTH, CELL, LOWER, WHOLE = 6, 18, 0.9, 256
#: Leaves compared at a time.
BATCH = 1 << 15
LANES, PAIRS, CROWD, FAMILY, SET_HASHES = 4, 1024, 20_000, 256, 4_000_000
_LANE = [f"w{k}" for k in range(LANES)]


def remixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Lane 0 has the hashes themselves, further lanes independent mixes of them."""
    if not lane:
        return hashes
    x = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (the whole row as one struct), id, text, and k0, k1: two hashes of all columns, alike for equal rows alone (but for one chance in 2^128 a pair)."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *row_keys(docs))


def wide_prints(rows: DataFrame, words: int) -> DataFrame:
    """id, k0, k1, key (of the shingle set, 32 hex digits), size, w0..w3."""

    def run(frames):
        for part in batches(frames):
            sets = [np.unique(np.array(shingle_hashes(t, words), np.uint64)) for t in part["text"]]
            sizes, flat = np.fromiter(map(len, sets), np.int64, len(sets)), np.concatenate(sets)
            lanes = {name: majority(remixed(flat, k), sizes).view(np.int64) for k, name in enumerate(_LANE)}
            yield pd.DataFrame({"id": part["id"], "k0": part["k0"], "k1": part["k1"], "key": [hashlib.md5(s.tobytes()).hexdigest() for s in sets], "size": sizes} | lanes)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "k0", "k1", "text").mapInPandas(run, f"id {kind}, k0 long, k1 long, key string, size long, " + ", ".join(f"{n} long" for n in _LANE))


def meeting(depth: int, given: int = 0) -> np.ndarray:
    """For 0 to DIFFERENCES differing bits, the chance that none is among `depth` chosen ones, if none is among `given` others."""
    alike = 64 * LANES - np.arange(DIFFERENCES + 1)
    return np.prod([(alike - i) / (64 * LANES - i) for i in range(given, given + depth)], axis=0)


def tables(chance: np.ndarray, recall: float, similarity: float = SIMILARITY) -> int:
    """How many tables that a pair meets in with this chance (by its differing bits) give a pair of this similarity the recall."""
    q, n = math.acos(2 * similarity / (1 + similarity)) / math.pi, 64 * LANES
    weight = np.array([math.comb(n, k) * q**k * (1 - q) ** (n - k) for k in range(DIFFERENCES + 1)])
    weight /= weight.sum()
    return next(t for t in itertools.count(1) if weight @ (1 - (1 - chance) ** t) >= recall)


@functools.cache
def lower_nodes(members: int, above: int) -> tuple[int, int]:
    """Depth and number of the choices of lower nodes in a cell of so many members, which shares `above` bits."""
    depth = max(1, math.ceil(math.log2(members + 1)) - 1)
    return depth, tables(meeting(depth, above), LOWER)


def hierarchies(count: int, recall: float = RECALL) -> tuple[int, int]:
    """Depth of the cells and number of hierarchies for so many documents."""
    depth = max(DEPTH, math.ceil(math.log2(count + 1)) - CELL)
    chance, members = meeting(depth), count >> depth
    if members > WHOLE // 2:
        inner, choices = lower_nodes(members, depth)
        chance = chance * (1 - (1 - meeting(inner, depth)) ** choices)
    return depth, tables(chance, recall)


def chosen_bits(table: int, depth: int) -> np.ndarray:
    """All bits in the order of a hierarchy: its first `depth` make the cells."""
    return np.random.default_rng([1, table, depth]).permutation(64 * LANES)


def pattern(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The chosen bits of each code (a row of LANES words) as a number."""
    out = np.zeros(len(words), np.uint64)
    for i, b in enumerate(bits.tolist()):
        out |= (words[:, b // 64] >> np.uint64(b % 64) & np.uint64(1)) << np.uint64(i)
    return out.view(np.int64)


def near_links(nodes: DataFrame, differences: int = DIFFERENCES) -> DataFrame:
    """Links (a, b) between the keys of nodes (key long, w0..w3; different keys), fewer than a cell's members per cell."""
    count = nodes.count()
    depth, many = hierarchies(count)
    crowd = CROWD * max(1, (count >> depth) >> 12)
    picked = [chosen_bits(t, depth)[:depth] for t in range(many)]

    def celled(frames: Iterator[pd.DataFrame], columns: list[str]):
        for frame in frames:
            for at in range(0, len(frame), 4096):
                part = frame.iloc[at : at + 4096]
                words = part[_LANE].to_numpy(np.int64).view(np.uint64)
                node = np.concatenate([pattern(words, p) + (t << 40) for t, p in enumerate(picked)])
                yield pd.DataFrame({"node": node} | {c: np.tile(part[c].to_numpy(), many) for c in columns})

    sizes = nodes.select(*_LANE).mapInPandas(lambda f: celled(f, []), "node long").groupBy("node").count()
    blocks = F.ceil(F.col("count") / max(1, crowd // 2)).cast("long")
    crowded = written(sizes.where(F.col("count") > crowd).select("node", blocks.alias("blocks")), "crowded")
    rows = nodes.select("key", *_LANE).mapInPandas(lambda f: celled(f, ["key", *_LANE]), "node long, key long, " + ", ".join(f"{n} long" for n in _LANE))
    return group_links(rows, crowded, lambda frame: _links(frame, differences, depth), max(1, crowd // 2))


def _links(rows: pd.DataFrame, differences: int, depth: int | None = None) -> pd.DataFrame:
    """Links within the blocks of rows, which lie together; given the depth of the cells, only within lower nodes of large ones."""
    word = np.ascontiguousarray(rows[_LANE].to_numpy(np.int64)).view(np.uint64)
    group, ask = rows[["node", "block"]].to_numpy(np.int64), rows["ask"].to_numpy(bool)
    head = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]).any(axis=1)))) if len(group) else np.empty(0, np.int64)
    size = np.diff(np.append(head, len(group)))
    forest = start_forest(rows)

    def near(a, b):
        ok = np.bitwise_count(word[a] ^ word[b]).sum(axis=-1) <= differences
        forest.join(a[ok], b[ok])
        return ok

    def meet(order: np.ndarray, size: np.ndarray) -> None:
        """Compares within groups of so many rows each, which follow one another in this order."""
        head = np.cumsum(size) - size
        end = np.repeat(np.where(size <= PAIRS, head + size, 0), size)
        at = np.flatnonzero(np.arange(len(order)) + 1 < end)
        step = 1
        while len(at):
            a, b = order[at], order[at + step]
            some = ask[a] | ask[b]
            near(a[some], b[some])
            step += 1
            at = at[at + step < end[at]]
        for h, n in zip(head[size > PAIRS].tolist(), size[size > PAIRS].tolist()):
            members = order[h : h + n]
            rest = np.flatnonzero(ask[members])
            for _ in range(HUBS):
                if not len(rest):
                    break
                near_hub = near(np.full(n, members[rest[len(rest) // 2]]), members)
                rest = rest[~near_hub[rest]]
            for x in still_asking(forest, members, rows).tolist():
                near(np.full(n, x), members)

    large = (size > WHOLE) & (depth is not None)
    meet(np.flatnonzero(~np.repeat(large, size)), size[~large])
    for h, n in zip(head[large].tolist(), size[large].tolist()):
        table = int(group[h, 0]) >> 40
        inner, choices = lower_nodes(n, depth)
        free = chosen_bits(table, depth)[depth:]
        mine, rng = word[h : h + n], np.random.default_rng([2, table])
        leaves = np.argsort(gray_rank(mine[:, 0]), kind="stable")
        at_once = max(1, BATCH // n)
        for c in range(0, choices, at_once):
            orders, sizes = [], []
            for _ in range(c, min(c + at_once, choices)):
                node = pattern(mine, rng.permutation(free)[:inner])[leaves]
                place = np.argsort(node, kind="stable")
                orders.append(h + leaves[place])
                sizes.append(np.diff(np.append(np.flatnonzero(np.diff(node[place], prepend=-1)), n)))
            meet(np.concatenate(orders), np.concatenate(sizes))
    key = rows["key"].to_numpy()
    edges = np.array(forest.edges, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": key[edges[:, 0]], "b": key[edges[:, 1]]})


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """The rows with set (the different shingles' hashes in order, 8 bytes each) in place of the text."""
    rest = [c for c in texts.columns if c != "text"]

    def run(frames):
        for part in batches(frames):
            yield part[rest].assign(set=[np.unique(np.array(shingle_hashes(t, words), np.uint64)).tobytes() for t in part["text"]])

    return texts.select(*rest, "text").mapInPandas(run, ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in rest) + ", set binary")


def _similar(rows: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links within the blocks of rows (with set), which lie together."""
    rows = rows[rows["set"].str.len() > 0].reset_index(drop=True)
    key, ask = rows["key"].to_numpy(np.int64), rows["ask"].to_numpy(bool)
    forest = start_forest(rows)
    sets = [np.frombuffer(s, np.uint64) for s in rows["set"]]
    for members in rows.groupby(["node", "block"], sort=False).indices.values():
        if len(members) < 2:
            continue
        own = [sets[i] for i in members]
        size = np.fromiter(map(len, own), np.int64, len(own))
        start = np.cumsum(size) - size
        number = np.unique(np.concatenate(own), return_inverse=True)[1]
        mark = np.zeros(number.max() + 1, np.int64)
        done = np.zeros(len(own), bool)

        def meet(i: int) -> np.ndarray:
            mine = number[start[i] : start[i] + size[i]]
            mark[mine] = 1
            both = np.add.reduceat(mark[number], start)
            mark[mine] = 0
            near = both >= similarity * (size + size[i] - both) - 1e-9
            forest.join(np.full(near.sum(), members[i]), members[near])
            done[i] = True
            return near

        rest = np.flatnonzero(ask[members])
        for _ in range(HUBS):
            if not len(rest):
                break
            near = meet(int(rest[len(rest) // 2]))
            rest = rest[~near[rest] & ~done[rest]]
        for i in np.flatnonzero(np.isin(members, still_asking(forest, members, rows)) & ~done).tolist():
            meet(i)
    edges = np.array(forest.edges, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": key[edges[:, 0]], "b": key[edges[:, 1]]})


def similar_links(sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect what pairs of sets (node, key, size, set) of this similarity connect within each node."""
    sizes = sets.groupBy("node").agg(F.count("*").alias("n"), F.sum("size").alias("hashes"))
    blocks = F.ceil(F.greatest(F.col("n") / max(1, FAMILY // 2), F.col("hashes") / (SET_HASHES // 2))).cast("long")
    crowded = written(sizes.where((F.col("n") > FAMILY) | (F.col("hashes") > SET_HASHES)).select("node", blocks.alias("blocks")), "crowded")
    return group_links(sets.select("node", "key", "set"), crowded, lambda frame: _similar(frame, similarity), max(1, FAMILY // 2))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, differences: int = DIFFERENCES, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group, with all columns of docs. docs should be a table read back, as it is read three times."""
    rows = keyed_rows(docs, id_col, text_col)
    prints = written(wide_prints(rows, words), "wide-prints")
    if not prints.groupBy("k0", "k1").count().where("count > 1").isEmpty():  # rows equal in every column become one where they lie
        rows = rows.dropDuplicates(["k0", "k1"])
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k0", "k1")).alias("first")
    nodes = prints.groupBy("key", "size", *_LANE).agg(first).withColumn("key", F.monotonically_increasing_id())
    nodes = written(nodes.select("key", "size", *_LANE, "first.id", "first.none", "first.k0", "first.k1"), "nodes")
    families = connected_components(near_links(nodes, differences).distinct()).select(F.col("node").alias("key"), F.col("root").alias("node"))
    members = nodes.join(families, "key").select("node", "key", "size", "k0", "k1")
    texts = rows.select("text", "k0", "k1").join(members, ["k0", "k1"]).select("node", "key", "size", "text")
    sets = written(shingle_sets(texts, words), "sets")
    roots = connected_components(similar_links(sets, similarity)).withColumnRenamed("node", "key")
    placed = nodes.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    stay = placed.groupBy("root").agg(F.min(F.struct("none", "id", "k0", "k1")).alias("s")).select("s.k0", "s.k1")
    kept = rows.select("row", "k0", "k1").join(stay, ["k0", "k1"], "left_semi")
    return kept.select("row.*")
