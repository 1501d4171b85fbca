"""Toxicity: a bag of subword embeddings, averaged, into a linear softmax, trained jointly in numpy.

A word is a run of letters and digits, lower-cased; its subwords are its byte n-grams of GRAMS lengths, with marks at both
ends, and the word as a whole, hashed to BUCKETS embeddings. Unseen spellings thus share the vectors of their n-grams. A
window of WINDOW words is the average of its words, a word the average of its subwords. A document counts as its most
toxic window, so that a long text is judged like a short one; training picks that window again before every round.

Fitting takes at most TRAIN_ROWS labelled rows, up to half of either label, in the order of a hash of the id, each id once
before any a second time; of those, shortest first, as many as hold half of TRAIN_CHARS characters of either label (one at
least). So long or repeated texts don't push out others, and both labels train if both have rows. Scoring takes every row
and the whole text.

Cases: a null text counts as empty; a text without words scores as a window of none (the bias alone); rows with a null id
or label don't train but are scored; if an id is labelled more than once, its highest label counts; a repeated document
trains once and scores as often as it occurs; with no label of one kind every score is 0; other columns are left out.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainfield.llm.bpe import KNOWN_BYTES, KNOWN_WORDS, batches
from grainfield.llm.wordsplit import LETTER, NUMBER, Flat, char_classes

BUCKETS, DIM, GRAMS = 1 << 17, 8, (3, 4, 5)
WINDOW, STRIDE = 12, 6
TRAIN_ROWS, TRAIN_CHARS = 4000, 20_000_000
ROUNDS, STEPS, POWER, RIDGE, DECAY = 6, 20, 6, 1500, 1e-4
_PRIME = np.uint32(16777619)


def word_spans(flat: Flat) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters and digits; a run ends where its text does."""
    n = len(flat.points)
    kinds = char_classes()[flat.points]
    inside = (kinds == LETTER) | (kinds == NUMBER)
    edge = np.zeros(n + 1, bool)
    edge[1:n] = inside[1:] != inside[:-1]
    edge[flat.bounds] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    keep = inside[starts] if n else np.zeros(0, bool)
    return starts[keep], ends[keep]


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words, laid end to end, and how many each word has."""
    marked = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint32)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), size)
    ends = np.cumsum(size)[word]
    at = np.arange(len(marked))
    of, found = [], []
    code = np.full(len(marked), 2166136261, np.uint32)
    for j in range(max(GRAMS)):
        part = code[: len(marked) - j] if j else code
        code = (part ^ marked[j:]) * _PRIME
        if j + 1 in GRAMS:
            whole = at[: len(code)] + j < ends[: len(code)]
            mixed = code[whole]
            of.append(word[: len(code)][whole])
            found.append((mixed ^ mixed >> np.uint32(15)) % np.uint32(BUCKETS))
    of.append(np.arange(len(words)))
    found.append(np.fromiter((zlib.crc32(w) % BUCKETS for w in words), np.uint32, len(words)))
    of, found = np.concatenate(of), np.concatenate(found)
    order = np.argsort(of, kind="stable")
    return found[order].astype(np.int32), np.bincount(of, minlength=len(words))


class WordValues(dict):
    """A number per word: the average over its subwords of one number per bucket."""

    def __init__(self, per_bucket: np.ndarray):
        self.per_bucket = per_bucket
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.values, self.bytes = np.empty(0), 0

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        i = self[word] = len(self)
        return i

    def of(self, words: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the words that are fresh in their texts, and how many each text has."""
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            bucket, count = subwords(self.new)
            start = np.concatenate(([0], np.cumsum(count)[:-1]))
            self.values = np.concatenate((self.values, np.add.reduceat(self.per_bucket[bucket], start) / count))
            self.bytes += sum(map(len, self.new))
            self.new = []
        keep = fresh(numbers, size)
        out = self.values[numbers[keep]], np.bincount(np.repeat(np.arange(len(size)), size)[keep], minlength=len(size))
        if len(self) > KNOWN_WORDS or self.bytes > KNOWN_BYTES:
            self.reset()
        return out


def fresh(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """True where a word (by number) did not occur among the WINDOW words before it in the same text."""
    text = np.repeat(np.arange(len(size)), size)
    order = np.argsort(words, kind="stable")
    keep = np.ones(len(words), bool)
    now, before = order[1:], order[:-1]
    keep[now] = (words[now] != words[before]) | (text[now] != text[before]) | (now - before > WINDOW)
    return keep


def windows(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many words, laid end to end: the text, first word and end of every window; the last window ends with the text."""
    count = np.maximum(1, -(-np.maximum(size - WINDOW, 0) // STRIDE) + 1)
    text = np.repeat(np.arange(len(size)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    base = (np.cumsum(size) - size)[text]
    first = np.minimum(k * STRIDE, np.maximum(size[text] - WINDOW, 0))
    return text, base + first, base + np.minimum(first + WINDOW, size[text])


def window_means(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values)))
    return (total[end] - total[first]) / np.maximum(end - first, 1)


def words_of(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """All words of the lower-cased texts, and how many each text has."""
    flat = Flat([t.lower() for t in texts])
    starts, ends = word_spans(flat)
    return flat.slices(starts, ends), np.diff(np.searchsorted(starts, flat.bounds))


@dataclass
class Model:
    """What scoring needs of a fitted model: per bucket the product of its embedding with the softmax weights, and the scale of the odds."""

    per_bucket: np.ndarray
    slope: float
    shift: float

    def scores(self, texts: list[str], known: WordValues) -> np.ndarray:
        values, size = known.of(*words_of(texts))
        text, first, end = windows(size)
        mean = window_means(values, first, end)
        top = np.maximum.reduceat(mean, np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1]))))
        return 1 / (1 + np.exp(-np.clip(self.slope * top + self.shift, -60, 60)))


class _Bags:
    """Bags of words (spans of the word list), as averages of averages of bucket values, and the way back."""

    def __init__(self, word: np.ndarray, bucket: np.ndarray, start: np.ndarray, count: np.ndarray, first: np.ndarray, end: np.ndarray):
        length = end - first
        self.rows = len(first)
        at = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(length.sum())
        key, times = np.unique(np.repeat(np.arange(self.rows), length) * max(1, len(count)) + word[at], return_counts=True)
        self.row = key // max(1, len(count))
        used, self.word = np.unique(key % max(1, len(count)), return_inverse=True)
        self.share = times / np.maximum(length, 1)[self.row]
        self.words, grams = len(used), count[used]
        self.bucket = bucket[np.repeat(start[used] - (np.cumsum(grams) - grams), grams) + np.arange(grams.sum())]
        self.of, self.part = np.repeat(np.arange(self.words, dtype=np.int32), grams), np.repeat((1 / grams).astype(np.float32), grams)

    def forward(self, per_bucket: np.ndarray) -> np.ndarray:
        per_word = np.bincount(self.of, per_bucket[self.bucket] * self.part, self.words)
        return np.bincount(self.row, per_word[self.word] * self.share, self.rows).astype(np.float64)

    def back(self, slope: np.ndarray) -> np.ndarray:
        per_word = np.bincount(self.word, slope[self.row] * self.share, self.words)
        return np.bincount(self.bucket, per_word[self.of] * self.part, BUCKETS).astype(np.float64)

    def curvature(self, cost: np.ndarray) -> np.ndarray:
        """A bound of the loss's second derivative by each bucket, as far as its words stand alone."""
        per_word = np.bincount(self.word, cost[self.row] / 4 * self.share**2, self.words)
        return np.bincount(self.bucket, per_word[self.of] * self.part**2, BUCKETS).astype(np.float64)


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model | None:
    """Trains embeddings and softmax together on four of five texts and fits the odds' scale on the fifth; None if a label is missing.

    The first round takes whole texts; each later round takes of every text its most toxic window so far, and of the
    clean ones one more at random. The two rows of the softmax act by their difference, whose gradient is that of the
    full softmax. Each embedding's step is divided by its curvature plus that of RIDGE rows, so that n-grams which many
    texts share move far and those of a few hardly; the largest eigenvalue, by power iteration, bounds the steps, and
    momentum speeds them.
    """
    label = np.array(labels, np.float64)
    if not 0 < label.sum() < len(label):
        return None
    rng = np.random.default_rng(seed)
    apart = np.arange(len(label)) % 5 == 4
    if not 0 < label[~apart].sum() < (~apart).sum() or not 0 < label[apart].sum() < apart.sum():
        apart[:] = False
    number: dict[bytes, int] = {}
    some, sizes = [], []
    for at in range(0, len(texts), 100):
        words, size = words_of(texts[at : at + 100])
        some.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
        sizes.append(size)
    word, size = np.concatenate(some), np.concatenate(sizes)
    del some, words
    keep = fresh(word, size)
    word, size = word[keep], np.bincount(np.repeat(np.arange(len(size)), size)[keep], minlength=len(size))
    bucket, count = subwords(list(number)) if number else (np.empty(0, np.int64), np.empty(0, np.int64))
    text, first, end = windows(size)
    head = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    tail = np.cumsum(size)
    start = np.cumsum(count) - count
    embedding, weight, bias = rng.normal(0, 0.01, (BUCKETS, DIM)), rng.normal(0, 1, DIM), 0.0
    weight /= np.sqrt(weight @ weight)

    def means() -> np.ndarray:
        per_word = np.add.reduceat((embedding @ weight)[bucket], start) / count if len(count) else np.empty(0)
        return window_means(per_word[word], first, end)

    for rnd in range(ROUNDS):
        if rnd:
            mean = means()
            at = np.flatnonzero(mean == np.maximum.reduceat(mean, head)[text])
            chosen = at[np.unique(text[at], return_index=True)[1]]
            other = head + (rng.random(len(head)) * np.diff(np.append(head, len(text)))).astype(np.int64)
            chosen = np.concatenate((chosen, other[label == 0]))
            of, lo, hi = text[chosen], first[chosen], end[chosen]
        else:
            of, lo, hi = np.arange(len(size)), tail - size, tail
        use = ~apart[of]
        of, lo, hi = of[use], lo[use], hi[use]
        y = label[of]
        cost = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
        bags = _Bags(word, bucket, start, count, lo, hi)
        scale = bags.curvature(cost)
        scale += RIDGE * cost.mean() / 4 * (np.median(bags.share) * np.median(bags.part)) ** 2 if bags.words else 1.0
        x = rng.normal(0, 1, BUCKETS)
        for _ in range(POWER):
            x /= np.sqrt(x @ x)
            y1 = bags.back(cost / 4 * bags.forward(x / np.sqrt(scale))) / np.sqrt(scale)
            top, x = np.sqrt(y1 @ y1), y1 if y1.any() else x
        pace = 0.8 / max(top, 1e-12)
        speed, w_speed, b_speed = np.zeros(BUCKETS), np.zeros(DIM), 0.0
        for step in range(STEPS):
            slope = cost * (1 / (1 + np.exp(-np.clip(bags.forward(embedding @ weight) + bias, -60, 60))) - y)
            back, keep = bags.back(slope), step / (step + 3)
            speed = keep * speed + pace * back / scale
            w_speed = keep * w_speed + 0.01 * embedding.T @ back
            b_speed = keep * b_speed + slope.sum()
            embedding -= np.outer(speed, weight / (weight @ weight)) + DECAY * embedding
            weight = weight - w_speed
            bias -= b_speed
    mean = means()
    top = np.maximum.reduceat(mean, head)
    use = apart if apart.any() else np.ones(len(label), bool)
    return Model((embedding @ weight).astype(np.float32), *_scale(top[use], label[use]))


def _scale(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through (x, y), by Newton steps with a little ridge."""
    mean, spread = x.mean(), x.std() or 1.0
    a = np.stack(((x - mean) / spread, np.ones(len(x))), 1)
    at = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ at, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag([0.5, 1e-3]), a.T @ (p - y) + np.array([0.5 * at[0], 0.0]))
        at -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0] / spread), float(at[1] - at[0] * mean / spread)


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 by division by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Fits on labelled rows that are not held out, bounded as the module's text says; one task trains, the driver gets the weights."""
    label = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).alias("_y"))
    label = label.join(docs.select(id_col), id_col, "left_semi").withColumn("_y", (F.col("_y") == 1).cast("int"))
    order, half = [F.xxhash64(id_col), F.col(id_col)], TRAIN_ROWS // 2
    picked = label.where("_y = 1").orderBy(*order).limit(half).union(label.where("_y = 0").orderBy(*order).limit(half))
    rows = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_t")).join(F.broadcast(picked), id_col).dropDuplicates([id_col, "_t"]).withColumn("_n", F.length("_t"))
    rows = rows.withColumn("_again", F.row_number().over(Window.partitionBy(id_col).orderBy("_n", "_t")))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_y").orderBy("_again", *order))).where(F.col("_k") <= half)
    short = Window.partitionBy("_y").orderBy("_n", *order, "_t")
    rows = rows.withColumn("_k", F.row_number().over(short)).withColumn("_n", F.sum("_n").over(short.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sample = rows.where((F.col("_n") <= TRAIN_CHARS // 2) | (F.col("_k") == 1)).select(id_col, "_t", "_y").repartition(1).sortWithinPartitions(*order, "_t")

    def one(frames):
        rows = pd.concat([pd.DataFrame({"_t": [], "_y": []}), *frames])
        model = fit(rows["_t"].tolist(), [int(y == 1) for y in rows["_y"]])
        if model:
            yield pd.DataFrame({"weights": [model.per_bucket.tobytes()], "slope": [model.slope], "shift": [model.shift]})

    found = sample.select("_t", "_y").mapInPandas(one, "weights binary, slope double, shift double").collect()
    return Model(np.frombuffer(found[0].weights, np.float32), found[0].slope, found[0].shift) if found else None


def score_toxicity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score (0 to 1) of every row; the model's numbers go along with the tasks (half a megabyte)."""

    def run(frames):
        known = WordValues(model.per_bucket) if model else None
        for part in batches(frames, text_col):
            yield pd.DataFrame({id_col: part[id_col], "score": model.scores(part[text_col].tolist(), known) if model else 0.0})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, score double")
