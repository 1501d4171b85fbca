"""Token files of directly addressable codes.

An id is cut into chunks of CHUNK_BITS, lowest first. Level k holds chunk k of every id that has one, a bitmap that says
which of them go on to level k+1, and a rank directory (ones before every RANK_BITS-th bit), so that any token is found
with one rank per level and no block is decoded. A file row is a segment: whole documents in order, up to SEGMENT_TOKENS
ids or one longer document. Segments lie in Parquet files without compression, one file per range of document ids.

Cases: a null text counts as empty; a null document id sorts first; rows that repeat an id lie side by side, by the hash
of their text and then the text; an empty table gives no segment; other columns are left out, so clashing names don't matter.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import struct
import unicodedata
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainfield.llm.bpe import WordTable, batches, encode_flat
from grainfield.llm.wordsplit import split_words

CHUNK_BITS, RANK_BITS, SEGMENT_TOKENS, WORDS_AT_ONCE = 8, 512, 1 << 18, 100
BEYOND_LATIN = re.compile("[^\u0000-\u02ff\u2010-\u2027\u20ac]")
_LEVEL = struct.Struct("<qqq")


def pack(ids: np.ndarray) -> bytes:
    """The levels of these ids (0 to 2^63-1), one after another: counts, bitmap, rank directory, chunks."""
    rest, out = np.asarray(ids, np.int64), []
    while True:
        more = rest >> CHUNK_BITS != 0
        bits = np.packbits(more, bitorder="little")
        ranks = np.concatenate(([0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.uint32)))).astype("<u4") if len(more) else np.zeros(1, "<u4")
        out += [_LEVEL.pack(len(rest), len(bits), len(ranks)), bits.tobytes(), ranks.tobytes(), (rest & 0xFF).astype(np.uint8).tobytes()]
        if not more.any():
            return b"".join(out)
        rest = rest[more] >> CHUNK_BITS


class Segment:
    """Reads packed ids: all of them, a range, or one."""

    def __init__(self, body: bytes):
        self.levels, at = [], 0
        while at < len(body):
            n, n_bits, n_ranks = _LEVEL.unpack_from(body, at)
            at += _LEVEL.size
            bits = np.frombuffer(body, np.uint8, n_bits, at)
            ranks = np.frombuffer(body, "<u4", n_ranks, at + n_bits)
            chunks = np.frombuffer(body, np.uint8, n, at + n_bits + 4 * n_ranks)
            self.levels.append((bits, ranks, chunks))
            at += n_bits + 4 * n_ranks + n

    def __len__(self) -> int:
        return len(self.levels[0][2])

    def token(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (bits, ranks, chunks) in enumerate(self.levels):
            value |= int(chunks[i]) << CHUNK_BITS * k
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(bits, ranks, i)
        return value

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        block = i // RANK_BITS
        part = bits[block * RANK_BITS // 8 : (i >> 3) + 1].copy()
        if len(part):
            part[-1] &= (1 << (i & 7)) - 1
        return int(ranks[block]) + int(np.bitwise_count(part).sum())

    def all(self) -> np.ndarray:
        value, at = self.levels[0][2].astype(np.int64), None
        for k, (bits, _, chunks) in enumerate(self.levels):
            if k:
                value[at] |= chunks.astype(np.int64) << CHUNK_BITS * k
            going = np.flatnonzero(np.unpackbits(bits, count=len(chunks), bitorder="little"))
            at = going if at is None else at[going]
        return value


class WordCoder:
    """A word-level vocabulary file through the tokenizers library, each different word once.

    Splitting gives the library's own words, so encoding them one by one gives its ids. Texts that hold a special
    token's string, or letters whose class and case depend on the library's Unicode version, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.special = [t["content"] for t in spec["added_tokens"]]
        byte_level = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "ByteLevel"]
        self.word = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": byte_level[0]}))
        vocab = spec["model"]["vocab"]
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each token
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.width[list(vocab.values())] = [len(t.removesuffix(suffix)) for t in vocab]
        self.table = WordTable(self._encode_words)

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words go to the library in lists of WORDS_AT_ONCE; its tokens tile a word's bytes, so their lengths tell the words apart."""
        texts = [w.decode("utf-8") for w in words]
        lists = [texts[i : i + WORDS_AT_ONCE] for i in range(0, len(texts), WORDS_AT_ONCE)]
        found = self.word.encode_batch_fast(lists, is_pretokenized=True, add_special_tokens=False)
        ids = np.fromiter(itertools.chain.from_iterable(x.ids for x in found), np.int64)
        ends, word_ends = np.cumsum(self.width[ids]), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        at = np.searchsorted(ends, word_ends)
        if len(ids) and ends[-1] == word_ends[-1] and (ends[at] == word_ends).all():
            return ids, np.diff(at + 1, prepend=0)
        one = [x.ids for x in self.word.encode_batch_fast(texts, add_special_tokens=False)]  # a vocabulary with unknown bytes
        return np.fromiter(itertools.chain.from_iterable(one), np.int64), np.fromiter(map(len, one), np.int64, len(one))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [not (BEYOND_LATIN.search(t) or any(s in t for s in self.special)) for t in texts]
        lower = [unicodedata.normalize("NFC", t).lower() if p else "" for t, p in zip(texts, plain)]
        ids, bounds = encode_flat(lower, self.table, split_words)
        out = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        for i in np.flatnonzero(~np.array(plain, bool)).tolist():
            out[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, np.int32)
        return out


@functools.cache
def word_coder(path: str) -> WordCoder:
    return WordCoder(path)


SEGMENTS = "part int, segment int, before long, n_tokens long, doc_ids array<long>, bounds array<long>, body binary"


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text, ends it with end_id and writes segments in ascending order of id_col (long) to folder.

    The texts are dealt by ranges of the id and sorted there, so that the files, in the order of `part` and `segment`,
    hold all ids in document order. `before` counts the ids of earlier segments of the same part.
    """

    def run(frames):
        coder, part = word_coder(path), TaskContext.get().partitionId()
        kept, names, size, before, segment = [], [], 0, 0, 0

        def flush():
            nonlocal kept, names, size, before, segment
            row = pd.DataFrame(
                {"part": [part], "segment": [segment], "before": [before], "n_tokens": [size], "doc_ids": [names], "bounds": [np.cumsum([0, *map(len, kept)])], "body": [pack(np.concatenate(kept))]}
            )
            kept, names, size, before, segment = [], [], 0, before + size, segment + 1
            return row

        for frame in batches(frames, text_col):
            names_here = [None if pd.isna(x) else int(x) for x in frame[id_col]]
            for name, ids in zip(names_here, coder.encode(frame[text_col].tolist())):
                if size and size + len(ids) + 1 > SEGMENT_TOKENS:
                    yield flush()
                kept.append(np.append(ids, np.int32(end_id)))
                names.append(name)
                size += len(ids) + 1
        if kept:
            yield flush()

    order = [F.col(id_col).asc_nulls_first(), F.xxhash64(text_col), F.col(text_col)]
    ranged = docs.select(F.col(id_col).cast("long").alias(id_col), text_col).repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    ranged.mapInPandas(run, SEGMENTS).write.option("compression", "none").parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The segments with `start`, the ids of all documents before each; one row per part is summed in order."""
    segments = spark.read.schema(SEGMENTS).parquet(folder)
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base"))
    return segments.join(F.broadcast(parts), "part").withColumn("start", F.col("base") + F.col("before")).drop("base")


def documents_of(segments: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document of read_token_files(): id_col, start, n_tokens, ids_crc32 (of little-endian 32-bit ids)."""

    def run(frames):
        for frame in frames:
            for row in frame.itertuples():
                ids = Segment(row.body).all().astype("<u4")
                at = np.asarray(row.bounds, np.int64)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pd.DataFrame({id_col: pd.array([None if x is None or pd.isna(x) else int(x) for x in row.doc_ids], "Int64"), "start": row.start + at[:-1], "n_tokens": np.diff(at), "ids_crc32": crc})

    return segments.select("start", "doc_ids", "bounds", "body").mapInPandas(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")
