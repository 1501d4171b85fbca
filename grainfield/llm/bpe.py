"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round the rank of every adjacent pair is known (binary search
over the sorted pair keys), each word merges all places of its lowest-ranked pair, and only the pairs beside a merge are
looked up again. Words are encoded once and kept in a bounded table.

Cases: a null text counts as empty and gives no ids; repeated rows give repeated results; an empty table gives an empty
one; other columns are left out, so clashing names don't matter. Texts are never cut: they are gathered into batches of
about BATCH_CHARS, and a longer text is a batch of its own.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from grainfield.llm.wordsplit import Flat, split_with_spaces

BATCH_CHARS = 1_000_000
#: Beyond so many words or bytes, the half of the known words that was not seen for longest is forgotten.
KNOWN_WORDS, KNOWN_BYTES = 500_000, 20_000_000
_NONE = np.int64(1 << 40)


@functools.cache
def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """The merge rules of a byte-level vocabulary, as sorted pair keys."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made
        of = byte_alphabet()
        self.first = np.zeros(256, np.int64)
        for c, b in of.items():
            self.first[b] = vocab[c]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        spelled = [b""] * size
        for token, i in vocab.items():
            if all(c in of for c in token):
                spelled[i] = bytes(of[c] for c in token)
        for token, i in self.special.items():
            spelled[i] = token.encode("utf-8")
        self.spelled = spelled

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, laid end to end, and how many each has."""
        size = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), size)
        symbol = self.first[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full(len(symbol), _NONE)  # of the pair that starts here
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.rank(symbol[inner], symbol[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            head = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            count = np.diff(np.append(head, len(word)))
            low = np.minimum.reduceat(rank, head)
            if (over := low == _NONE).any():
                out = np.repeat(over, count)
                done.append((word[out], symbol[out]))
                word, symbol, rank = word[~out], symbol[~out], rank[~out]
                low, count = low[~over], count[~over]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == np.repeat(low, count))
            run = np.concatenate(([True], np.diff(at) != 1))  # aaa: of pairs that overlap, every second one from the left
            offset = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            at = at[offset % 2 == 0]
            symbol[at] = self.made[rank[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # places after the right halves are gone
            word, symbol, rank = word[keep], symbol[keep], rank[keep]
            rank[at] = _NONE
            for x in (at[(at + 1 < len(word))], at[at > 0] - 1):
                x = x[word[x] == word[x + 1]]
                rank[x] = self.rank(symbol[x], symbol[x + 1])
        if not done:
            return np.empty(0, np.int64), size
        words_out = np.concatenate([w for w, _ in done])
        order = np.argsort(words_out, kind="stable")
        return np.concatenate([s for _, s in done])[order], np.bincount(words_out, minlength=len(words))


class WordTable(dict):
    """Known words by number; fill() encodes those that were asked for and not yet known. The ids lie in one flat array."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.new: list[bytes] = []
        self.ids, self.bounds = np.empty(0, np.int32), np.zeros(1, np.int64)
        self.seen, self.turn, self.bytes = np.empty(0, np.int64), 0, 0

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        i = self[word] = len(self)
        return i

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The numbers of these words, known from now on."""
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            ids, count = self.encode(self.new)
            self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
            self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(count)))
            self.seen = np.concatenate((self.seen, np.zeros(len(self.new), np.int64)))
            self.bytes += sum(map(len, self.new))
            self.new = []
        self.turn += 1
        self.seen[out] = self.turn
        return out

    def spread(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words, laid end to end, and where each word's ids start, and the end."""
        at, count = self.bounds[numbers], self.bounds[numbers + 1] - self.bounds[numbers]
        bounds = np.concatenate(([0], np.cumsum(count)))
        return self.ids[np.repeat(at - bounds[:-1], count) + np.arange(bounds[-1])], bounds

    def trim(self) -> None:
        if len(self) <= KNOWN_WORDS and self.bytes <= KNOWN_BYTES:
            return
        words = list(self)
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.lexsort((size, -self.seen))
        fits = (np.arange(len(order)) < KNOWN_WORDS // 2) & (np.cumsum(size[order]) <= KNOWN_BYTES // 2)
        keep = np.sort(order[fits])
        self.ids, self.bounds = self.spread(keep)
        self.seen, self.bytes = self.seen[keep], int(size[keep].sum())
        kept = [words[i] for i in keep.tolist()]
        self.clear()
        self.update(zip(kept, range(len(kept))))


def encode_flat(texts: list[str], table: WordTable, split=split_with_spaces) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, laid end to end, and where each text's ids start, and the end."""
    flat = Flat(texts)
    starts, ends = split(flat)
    one, kind = flat.different(starts, ends)
    numbers = table.numbers(flat.slices(starts[one], ends[one]))[kind]
    ids, bounds = table.spread(numbers)
    out = ids, bounds[np.searchsorted(starts, flat.bounds)]
    table.trim()
    return out


class Codec:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str):
        self.merger = Merger(path)
        self.table = WordTable(self.merger.merge)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids per text; the vocabulary's special strings get their own ids, as in the tokenizers library."""
        parts, owner, fixed = [], [], {}
        for i, text in enumerate(texts):
            for piece in self._pieces(text):
                if isinstance(piece, int):
                    fixed[len(parts)] = piece
                    piece = ""
                parts.append(piece)
                owner.append(i)
        ids, bounds = encode_flat(parts, self.table)
        if not fixed:
            return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for k, i in enumerate(owner):
            out[i].append(np.array([fixed[k]], np.int32) if k in fixed else ids[bounds[k] : bounds[k + 1]])
        return [np.concatenate(x) for x in out]

    def _pieces(self, text: str) -> list[str | int]:
        pieces: list[str | int] = [text]
        for token, i in self.merger.special.items():
            if token in text:
                pieces = [y for x in pieces for y in ([x] if isinstance(x, int) else [z for s in x.split(token) for z in (s, i)][:-1])]
        return pieces

    def decode(self, ids: np.ndarray) -> str:
        spelled = self.merger.spelled
        return b"".join([spelled[i] for i in ids.tolist()]).decode("utf-8", "replace")


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def batches(frames: Iterator[pd.DataFrame], text: str = "text", chars: int = BATCH_CHARS) -> Iterator[pd.DataFrame]:
    """The same rows, null texts empty, in frames of about so many characters."""
    for frame in frames:
        frame = frame.assign(**{text: frame[text].fillna("")})
        at = (frame[text].str.len().cumsum() - 1).clip(lower=0) // chars
        for _, part in frame.groupby(at, sort=False):
            yield part


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its ids by the vocabulary file at path, which every executor can read.

    Returns id_col, ids array<int>. See the module's text for nulls, long texts and repeats.
    """

    def run(frames):
        coder = codec(path)
        for part in batches(frames, text_col):
            yield pd.DataFrame({id_col: part[id_col], "ids": coder.encode(part[text_col].tolist())})

    return docs.select(id_col, text_col).mapInPandas(run, f"{_typed(docs, id_col)}, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per row of (id_col, ids) with its text; null ids give an empty text, bad UTF-8 gives U+FFFD."""

    def run(frames):
        coder = codec(path)
        for frame in frames:
            texts = [coder.decode(np.asarray([] if x is None else x, np.int64)) for x in frame["ids"]]
            yield pd.DataFrame({id_col: frame[id_col], "text": texts})

    return encoded.select(id_col, "ids").mapInPandas(run, f"{_typed(encoded, id_col)}, text string")


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: id_col, n_tokens long, ids_sha256 (decimal ids joined by commas), decoded_sha256."""

    def run(frames):
        coder = codec(path)
        decimal = [str(i) for i in range(len(coder.merger.spelled))]
        for part in batches(frames, text_col):
            encoded = coder.encode(part[text_col].tolist())
            yield pd.DataFrame(
                {
                    id_col: part[id_col],
                    "n_tokens": [len(x) for x in encoded],
                    "ids_sha256": [hashlib.sha256(",".join([decimal[i] for i in x.tolist()]).encode()).hexdigest() for x in encoded],
                    "decoded_sha256": [hashlib.sha256(coder.decode(x).encode("utf-8")).hexdigest() for x in encoded],
                }
            )

    return docs.select(id_col, text_col).mapInPandas(run, f"{_typed(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _typed(df: DataFrame, column: str) -> str:
    return f"`{column}` {df.schema[column].dataType.simpleString()}"
