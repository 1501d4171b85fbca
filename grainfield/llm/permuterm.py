"""Spelling variants: words one edit apart, found by rotations of marked words, and the common form each leads to.

A word w, marked with a terminator, is turned at every place: of w = x c y the turn y$x + c begins with what is left when the
character c is skipped. Two words that differ in that one character share the prefix y$x, and so does the turn of the word xy
that lacks it. So a group of equal prefixes holds at most one word per character and one word without, and its rows are all
one edit apart; groups are scanned in sorted order and give each member its number of neighbours and the best one, never
pairs. Where a character stands in a run of equal ones only its first place counts as lacking, so a pair of words meets as
insertion or deletion once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfield.llm.bpe import batches
from grainfield.llm.shared import written

#: Longer turns (in code points) have hashes as keys and longer words digests as names, so that a word of any length takes a few bytes per place.
LONG = 64
#: A task hands on its counts when it has so many different words, and turns in frames of so many rows.
HELD, ROWS = 300_000, 200_000
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
_CRC = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)
_PRIME, _BASE = (1 << 61) - 1, 0x1F35A7BD1E4C3B29
WHOLE, FIRST, LATER = 0, 1, 2


def _step(crc: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _CRC[(crc ^ byte) & 255] ^ (crc >> np.uint32(8))


def _crcs(letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """CRC-32 of each word's UTF-8 after a begun register, letter by letter for all words that have one more."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes, crc = starts[order], sizes[order], begun[order].copy()
    live = len(order)
    for j in range(int(sizes[0]) if live else 0):
        live = int(np.searchsorted(-sizes[:live], -j, "left"))  # those with more than j letters
        byte = letters[starts[:live] + j].astype(np.uint32)
        wide = np.flatnonzero(byte >= 0xC0)  # two bytes in UTF-8
        if len(wide):
            crc[wide] = _step(crc[wide], np.uint32(0xC3))
            byte[wide] -= np.uint32(0x40)
        crc[:live] = _step(crc[:live], byte)
    out = np.empty_like(crc)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def _counted(ids: list[str], texts: list[str], damage: int) -> Counter:
    """Words (Latin-1, A-Z lowered) of some texts with their counts, some damaged as count_words() says."""
    plain = [t.encode("latin-1", "replace") for t in texts]
    buffer = b" ".join(plain).translate(_LETTERS)
    found = Counter(buffer.split())
    if not damage or not found:
        return found
    letters = np.frombuffer(buffer, np.uint8)
    edges = np.flatnonzero(np.diff(letters != 32, prepend=False, append=False))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    doc = np.searchsorted(np.cumsum([0] + [len(p) + 1 for p in plain]), starts, "right") - 1
    begun = np.array([zlib.crc32(f"{i}:".encode()) ^ 0xFFFFFFFF for i in ids], np.uint32)[doc]
    crc, short = np.ones(len(starts), np.uint32), sizes <= LONG
    crc[short] = _crcs(letters, starts[short], sizes[short], begun[short])
    for k in np.flatnonzero(~short):
        crc[k] = zlib.crc32(buffer[starts[k] : starts[k] + sizes[k]].decode("latin-1").encode(), int(begun[k]) ^ 0xFFFFFFFF)
    for k in np.flatnonzero(crc % damage == 0):
        word, at = buffer[starts[k] : starts[k] + sizes[k]], int(crc[k]) % int(sizes[k])
        found[word] -= 1
        found[word[:at] + word[at + 1 :]] += 1
    return found


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 6, least: int = 5, damage: int = 0) -> DataFrame:
    """word, n: runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z lowered, of so many code points and occurrences at least.

    With damage, a word whose h = crc32 of "id:word" it divides loses its code point h modulo length first. Null and empty
    texts have no words; a null id counts as an empty one; repeated rows count each; an empty table gives an empty one; other
    columns are left out, whatever their names. Tasks add up what they see before anything is shuffled.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def given() -> Iterator[pd.DataFrame]:
            kept = [(w.decode("latin-1"), n) for w, n in held.items() if len(w) >= shortest and n > 0]
            if kept:
                yield pd.DataFrame(kept, columns=["word", "n"])
            held.clear()

        for part in batches(frames, "_text"):
            held.update(_counted(part["_id"].fillna("").tolist(), part["_text"].tolist(), damage))
            if len(held) > HELD:
                yield from given()
        yield from given()

    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text")).mapInPandas(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _hashes(word: str) -> list[int]:
    out = [0]
    for c in word:
        out.append((out[-1] * _BASE + ord(c) + 1) % _PRIME)
    return out


def _turn_keys(word: str, skip: int, longest: int) -> list[str]:
    """Keys y$x of the turns of a word at every place, with no (0) or one (1) character between x and y; hashed if they are long."""
    size = len(word)
    if size - skip <= longest:
        return [f"{word[i + skip:]}${word[:i]}" for i in range(size + 1 - skip)]
    before, after = _hashes(word), _hashes(word[::-1])
    return [f"${i:x},{size - skip - i:x},{before[i]:x},{after[size - skip - i]:x}" for i in range(size + 1 - skip)]


def rotations(words: DataFrame, longest: int = LONG) -> DataFrame:
    """key, kind (whole word, character skipped at the first or a later place of its run), skipped, name, n of every turn of the rows (word, name, n)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns: tuple[list, ...] = ([], [], [], [], [])

        def given() -> Iterator[pd.DataFrame]:
            if columns[0]:
                yield pd.DataFrame(dict(zip(("key", "kind", "skipped", "name", "n"), columns)))
            for c in columns:
                c.clear()

        for frame in frames:
            for word, name, n in zip(frame["word"], frame["name"], frame["n"]):
                whole, cut = _turn_keys(word, 0, longest), _turn_keys(word, 1, longest) if word else []
                kinds = [FIRST if i == 0 or word[i] != word[i - 1] else LATER for i in range(len(word))]
                for c, more in zip(columns, (whole + cut, [WHOLE] * len(whole) + kinds, [-1] * len(whole) + [ord(x) for x in word], [name] * (len(whole) + len(cut)), [n] * (len(whole) + len(cut)))):
                    c.extend(more)
                if len(columns[0]) >= ROWS:
                    yield from given()
        yield from given()

    return words.select("word", "name", "n").mapInPandas(run, "key string, kind int, skipped int, name string, n long")


def _neighbours(kind: np.ndarray, name: np.ndarray, n: np.ndarray, group: np.ndarray, heads: np.ndarray) -> Iterator[tuple]:
    """(name, count, best name, best n) of the members of groups of two or more rows, sorted by n descending and skipped character.

    A whole word and a word with the character at a later place of its run are the same pair as at the first place, and not
    neighbours here. Between a whole word and the best of the others with as many occurrences the texts decide, so both are given.
    """
    rows, far = np.arange(len(kind)), len(kind)
    least = lambda mask: np.minimum.reduceat(np.where(mask, rows, far), heads)[group]
    total = lambda mask: np.add.reduceat(mask.astype(np.int64), heads)[group]
    whole, first, cut = kind == WHOLE, kind == FIRST, kind != WHOLE
    best = least(cut)
    other = np.where(rows == best, least(cut & (rows != best)), best)  # the best other word with a character here
    count = np.where(whole, total(first), total(cut) - 1 + np.where(first, total(whole), 0))
    for mine, one in ((whole, least(first)), (cut, other), (first, least(whole))):
        for r in np.flatnonzero(mine & (one < far)):
            yield name[r], int(count[r]), name[one[r]], int(n[one[r]])
            count[r] = 0  # counted once, also where both are given


def near_words(turns: DataFrame) -> DataFrame:
    """name, n_near, best_n, best: per name and group the number of neighbours and the best ones, from sorted groups of equal keys."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: pd.DataFrame | None = None  # the last group, which may go on in the next frame: at most one row per character and one more

        def scanned(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            key = rows["key"].to_numpy(object)
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            group = np.cumsum(new) - 1
            many = np.bincount(group, minlength=1)[group] > 1
            kind, name, n, new = (x[many] for x in (rows["kind"].to_numpy(), rows["name"].to_numpy(object), rows["n"].to_numpy(), new))
            if len(kind) and (found := list(_neighbours(kind, name, n, np.cumsum(new) - 1, np.flatnonzero(new)))):
                yield pd.DataFrame(found, columns=["name", "n_near", "best", "best_n"])

        for frame in frames:
            frame = frame if left is None else pd.concat([left, frame], ignore_index=True)
            if len(frame):
                last = (frame["key"] == frame["key"].iloc[-1]).to_numpy()
                left = frame[last]
                yield from scanned(frame[~last])
        if left is not None:
            yield from scanned(left)

    dealt = turns.repartition("key").sortWithinPartitions("key", F.desc("n"), "skipped")
    return dealt.mapInPandas(run, "name string, n_near long, best string, best_n long")


def _with_roots(linked: DataFrame) -> DataFrame:
    """word, root of every word with a form: forms are followed by doubling, as many rounds as the logarithm of the longest way."""
    ways = written(linked.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = written(ways.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        ways = step.drop("moved")
        if step.where("moved").isEmpty():
            return ways


def spelling_forms(words: DataFrame, ratio: int = 5, longest: int = LONG) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of words (word, n; each word once).

    Words are near if they differ by one inserted, deleted or replaced code point. The form is the near word of the largest n
    (ties: the smallest in code-point order) if its n is at least ratio times the word's, else null; the root is where forms
    lead, the word itself without one. Null words are left out; words of any length are compared whole (of long ones, hashes
    of what stands before and after the skipped character); an empty table gives an empty one; other columns are left out.
    """
    words = written(words.where(F.col("word").isNotNull()).select("word", "n"), "words")
    named = words.withColumn("name", F.when(F.length("word") <= longest, F.col("word")).otherwise(F.concat(F.lit("$"), F.sha2("word", 256))))
    found = near_words(rotations(named, longest))
    long = named.where(F.length("word") > longest).select(F.col("name").alias("best"), F.col("word").alias("_text"))
    if not long.isEmpty():  # ties are broken by texts, not by digests
        found = found.join(long, "best", "left").withColumn("best", F.coalesce("_text", "best")).drop("_text")
    near = found.groupBy("name").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b"))
    close = F.col("form_n") >= ratio * F.col("n")
    rows = named.join(near, "name", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("b.best").alias("form"), (-F.col("b.m")).alias("form_n"))
    rows = written(rows.withColumns({"form": F.when(close, F.col("form")), "form_n": F.when(close, F.col("form_n"))}), "forms")
    roots = _with_roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
