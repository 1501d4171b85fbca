"""SimHash near-duplicates over the Gray-order index.

Words are runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage return; A-Z count as
a-z. A text's shingles are its runs of `words` words, repeats included, joined by one blank; a shorter text is one
shingle; a text without words has fingerprint zero. Null texts count as empty. Rows are never dropped: equal texts and
repeated rows share a fingerprint. An empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfield.llm.bpe import batches
from grainfield.llm.components import connected_components
from grainfield.llm.gray_index import near_forest
from grainfield.llm.shared import join_counted, written

#: For each byte, its bits (highest first) as eight one-byte counters; 255 of them can be added.
_COUNTERS = np.array([sum((b >> 7 - i & 1) << 8 * i for i in range(8)) for b in range(256)], np.uint64)
_FULL = 255


def shingle_hashes(text: str, words: int) -> list[int]:
    """XXH64 (UTF-8, seed 42) of each shingle, in text order."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    found = text.encode("utf-8").lower().split()
    if len(found) <= words:
        return [digest(b" ".join(found), 42)] if found else []
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    return [digest(line[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprint of each group of consecutive hashes: bits set in over half of them; zero for an empty group."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    sizes = sizes[full]
    ends = np.cumsum(sizes)
    pieces = -(-sizes // _FULL)
    of = np.repeat(np.arange(len(sizes)), pieces)
    first = np.concatenate(([0], np.cumsum(pieces)[:-1]))
    start = (ends - sizes)[of] + (np.arange(len(of)) - first[of]) * _FULL
    raw = np.ascontiguousarray(hashes.astype(">u8")).view(np.uint8).reshape(-1, 8)
    counts = np.empty((len(of), 64), np.uint8)
    for j in range(8):
        counts[:, 8 * j : 8 * j + 8] = np.add.reduceat(_COUNTERS[raw[:, j]], start).astype("<u8").view(np.uint8).reshape(-1, 8)
    total = np.add.reduceat(counts.astype(np.int64), first, axis=0)
    out[full] = np.packbits(2 * total > sizes[:, None], axis=1).view(">u8").ravel()
    return out


def _hashed(frames: Iterator[pd.DataFrame], text_col: str, words: int):
    for part in batches(frames, text_col):
        found = [np.array(shingle_hashes(t, words), np.uint64) for t in part[text_col]]
        yield part, np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and fingerprint (long, the 64 bits as they are) of every row."""

    def run(frames):
        for part, hashes, sizes in _hashed(frames, text_col, words):
            yield pd.DataFrame({id_col: part[id_col], "fingerprint": majority(hashes, sizes).view(np.int64)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, fingerprint long")


def near_components(prints: DataFrame, radius: int = 2, id_col: str = "doc_id") -> DataFrame:
    """Rows of (id_col, fingerprint) with component_id: the least id reachable by steps of at most radius bits.

    Equal fingerprints are one node, so copies never meet as pairs. Rows with a null id get their component's least id,
    null if it has none.
    """
    nodes = written(prints.groupBy("fingerprint").agg(F.min(id_col).alias("least"), F.count("*").alias("copies")), "fingerprints")
    roots = connected_components(near_forest(nodes, "fingerprint", radius)).withColumnRenamed("node", "fingerprint")
    placed = written(nodes.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint")), "placed")
    classes = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"), F.sum("copies").alias("rows"))
    total = classes.agg(F.coalesce(F.sum("members"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    named = join_counted(placed, classes.drop("rows"), "root", "members", total[0]).select("fingerprint", "copies", "component_id")
    return join_counted(prints, named, "fingerprint", "copies", total[1]).select(id_col, "fingerprint", "component_id")


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint, component_id of every row. The fingerprints are written once, as several steps read them."""
    return near_components(written(fingerprints(docs, words, id_col, text_col), "simhash"), radius, id_col)
