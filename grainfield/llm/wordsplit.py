"""Pre-tokenisation of many texts at once, over one flat array of code points."""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = 1, 2, 3, 0, 255

#: The code points with the Unicode property White_Space.
WHITE_SPACE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def char_classes() -> np.ndarray:
    r"""The class of each code point: \p{L}, \p{N}, \s or none of them; UNKNOWN where Python's Unicode has no character yet."""
    kinds = {"L": LETTER, "N": NUMBER}
    of = lambda c: UNKNOWN if c == "Cn" else kinds.get(c[0], OTHER)
    table = np.fromiter((of(unicodedata.category(chr(c))) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[WHITE_SPACE] = SPACE
    return table


def classes_of(points: np.ndarray) -> np.ndarray:
    """The classes of these code points. What Python's Unicode doesn't know is asked of the tokenizers library, once each."""
    table = char_classes()
    kinds = table[points]
    if len(kinds) and kinds.max() == UNKNOWN:
        from tokenizers import pre_tokenizers

        pieces = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        for c in np.unique(points[kinds == UNKNOWN]).tolist():
            joins = [k for k, mate in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(pieces(mate + chr(c))) == 1]
            table[c] = joins[0] if joins else SPACE
        kinds = table[points]
    return kinds


class Flat:
    """Texts laid end to end as code points and as UTF-8; bounds has where each text starts, and the end."""

    def __init__(self, texts: list[str]):
        joined = "".join(texts)
        self.utf8 = joined.encode("utf-8")
        self.bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        if len(self.utf8) == len(joined):
            self.points, self.byte_at = np.frombuffer(self.utf8, np.uint8), None
        else:
            self.points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            p = self.points
            width = 1 + (p >= 0x80).astype(np.int8) + (p >= 0x800) + (p >= 0x10000)
            self.byte_at = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))

    def in_bytes(self, places: np.ndarray) -> np.ndarray:
        return places if self.byte_at is None else self.byte_at[places]

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        starts, ends, utf8 = self.in_bytes(starts), self.in_bytes(ends), self.utf8
        return [utf8[a:b] for a, b in zip(starts.tolist(), ends.tolist())]

    def different(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of one word of each kind, and for every word its kind.

        Words of up to 7 bytes are told apart by one number (bytes and length), those of up to 15 by two; longer ones
        are each their own kind.
        """
        at, size = self.in_bytes(starts).astype(np.int64), (self.in_bytes(ends) - self.in_bytes(starts)).astype(np.int64)
        eight = np.lib.stride_tricks.as_strided(np.frombuffer(self.utf8 + bytes(16), np.uint8), (len(self.utf8) + 9, 8), (1, 1))
        first, kind, base = [], np.empty(len(at), np.int64), 0
        for low, high in ((0, 7), (8, 15)):
            some = np.flatnonzero((size >= low) & (size <= high))
            if not len(some):
                continue
            there, length = at[some], size[some]
            last = (length - (8 if low else 0)).astype(np.uint64)
            key = eight[there + (8 if low else 0)].view("<u8").ravel() & ((np.uint64(1) << np.uint64(8) * last) - np.uint64(1)) | last << np.uint64(56)
            if low:
                heads = np.unique(eight[there].view("<u8").ravel(), return_inverse=True)[1]
                tails, mine = np.unique(key, return_inverse=True)
                key = heads * len(tails) + mine
            _, one, mine = np.unique(key, return_index=True, return_inverse=True)
            first.append(some[one])
            kind[some] = base + mine
            base += len(one)
        rest = np.flatnonzero(size > 15)
        kind[rest] = base + np.arange(len(rest))
        return np.concatenate([*first, rest]), kind


def _contractions(points: np.ndarray, start: np.ndarray, kind: np.ndarray, length: np.ndarray, joined: np.ndarray, last: np.ndarray):
    """Runs that are a lone apostrophe before s, t, m, d, re, ve or ll, and how many letters go with it."""
    follows = np.zeros(len(kind), bool)
    follows[:-1] = kind[1:] == LETTER
    at = np.flatnonzero((kind == OTHER) & (length == 1) & ~joined & ~last & follows)
    at = at[points[start[at]] == ord("'")]
    one = points[start[at] + 1]
    two = points[np.minimum(start[at] + 2, len(points) - 1)]
    long = length[np.minimum(at + 1, len(length) - 1)] >= 2
    k = np.isin(one, [ord(c) for c in "stmd"]).astype(np.int64)
    pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    k = np.where(pair & long, 2, k)
    return at[k > 0], k[k > 0]


def _runs(flat: Flat):
    points, n = flat.points, len(flat.points)
    kinds = classes_of(points)
    new = np.empty(n, bool)
    new[:1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=new[1:])
    heads = flat.bounds[:-1]
    heads = heads[heads < n]
    new[heads] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    head = np.zeros(n + 1, bool)
    head[heads] = True
    head[n] = True
    return points, kinds, start, end, kinds[start], head[end], head[start]


def split_with_spaces(flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    r"""Starts and ends by `'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+`.

    The pieces tile the texts, so it is enough to mark where each one starts. A white-space run before other text gives
    up its last character: a blank goes to what follows, any other stands alone.
    """
    n = len(flat.points)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points, _, start, end, kind, last, first = _runs(flat)
    mark = np.zeros(n, bool)
    mark[start] = True
    white = kind == SPACE
    mark[end[white & ~last] - 1] = True
    joined = np.zeros(len(start), bool)
    joined[1:] = white[:-1] & ~first[1:] & (points[start[1:] - 1] == 0x20)
    mark[start[joined]] = False
    at, k = _contractions(points, start, kind, end - start, joined, last)
    mark[start[at] + 1] = False
    rest = start[at] + 1 + k
    mark[rest[rest < n]] = True
    starts = np.flatnonzero(mark)
    return starts, np.append(starts[1:], n)


def split_words(flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    r"""Starts and ends by `'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+`; white space is left out."""
    n = len(flat.points)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points, kinds, start, end, kind, last, _ = _runs(flat)
    mark = kinds == NUMBER
    mark[start] = True
    at, k = _contractions(points, start, kind, end - start, np.zeros(len(start), bool), last)
    mark[start[at] + 1] = False
    rest = start[at] + 1 + k
    mark[rest[rest < n]] = True
    starts = np.flatnonzero(mark)
    ends = np.append(starts[1:], n)
    keep = kinds[starts] != SPACE
    return starts[keep], ends[keep]
