"""Approximate nearest neighbours by randomly rotated one-bit codes.

Equal vectors are one point, which keeps its smallest ids. Points are dealt to lists by their nearest centroid. Within a
list the residual is turned by a random rotation and only the signs are kept, one bit per dimension, along with two scalars:
the residual's length and the inner product of the unit residual with its code. From the packed bits and these scalars a
query, itself sent as one byte per dimension, estimates every inner product, with an error bound. Whatever could still be
among the nearest by its bound is compared with the whole residual (4 bytes per dimension), which leaves little more than the
nearest; these are measured with the original vectors, in double precision.

A query first visits its nearest lists until they hold CANDIDATES points. The distance of its k-th nearest of these is a
limit: of the other lists it visits those that can hold something nearer, by their centroid's distance and the lengths of
their residuals, with VISIT deviations for the angle between them. Clustered vectors so get by with few lists (measured: 4 %
of the points), vectors without clusters need most (79 %, recall 0.99).

The centroids are fitted on at most SAMPLE points (in the order of a hash of the id); every point is coded, once, into a
table. A task holds a part of a list (LIST points, or twice the mean of all lists if that is less) and a block of its queries
(QUERIES); the original vectors of the last candidates are joined by id.

Cases: vectors that are null, empty, zero, of another length than the most common one, or with null or non-finite parts
take no part, as queries or candidates; rows with a null id don't either. Of rows that repeat a query's id one is the
query, none its candidate; rows that repeat an id with an equal vector are one candidate. Equal distances go by the smaller
id. An empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainfield.llm.shared import written

SAMPLE, MOST_LISTS, CANDIDATES, LIST, LEAST, QUERIES = 20_000, 4096, 1000, 16_384, 512, 4096
#: Deviations of the codes' error bound, and of the angle between a list's residuals and a query.
EPSILON, VISIT = 3.0, 2.5


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def encode(residual: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths, and inner products of unit residual and code."""
    turned = residual @ turn
    length = np.sqrt((turned**2).sum(1))
    match = np.abs(turned).sum(1) / np.sqrt(turned.shape[1]) / np.where(length > 0, length, 1)
    return np.packbits(turned > 0, axis=1), length, np.where(length > 0, match, 1.0)


def squeeze(turned: np.ndarray) -> tuple[np.ndarray, ...]:
    """Turned query residuals as one byte per dimension, with offset, step, length, and how far the bytes are from them."""
    low = turned.min(1, keepdims=True)
    step = np.maximum(turned.max(1, keepdims=True) - low, 1e-300) / 255
    packed = np.rint((turned - low) / step).astype(np.uint8)
    return packed, low[:, 0], step[:, 0], np.sqrt((turned**2).sum(1)), np.sqrt(((packed * step + low - turned) ** 2).sum(1))


def bounds(codes: np.ndarray, length: np.ndarray, match: np.ndarray, query: tuple[np.ndarray, ...], epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances from squeezed query residuals (rows) to coded residuals (columns)."""
    packed, low, step, reach, _ = query
    dim = packed.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32)
    turned = packed.astype(np.float32) * step[:, None].astype(np.float32) + low[:, None].astype(np.float32)
    dot = (2 * (turned @ signs.T) - turned.sum(1, keepdims=True)) / np.sqrt(dim)
    inner = dot / match
    own = np.sqrt(np.maximum(1 - match**2, 0)) / np.sqrt(max(dim - 1, 1)) * reach[:, None]
    error = epsilon * np.sqrt(own**2 + step[:, None] ** 2 / 12) / match + 1e-4 * reach[:, None]
    base = length**2 + reach[:, None] ** 2
    return base - 2 * length * (inner + error), base - 2 * length * (inner - error)


def centroids(sample: np.ndarray, k: int, seed: int = 3, rounds: int = 8) -> np.ndarray:
    """k-means on a bounded sample; an empty cluster takes a random point."""
    rng = np.random.default_rng(seed)
    centre = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        near = nearest(sample, centre, 1)[:, 0]
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, near, sample)
        centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], sample[rng.integers(0, len(sample), k)])
    return centre


def nearest(points: np.ndarray, centre: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n nearest centroids of each point, nearest first."""
    out = np.empty((len(points), n), np.int64)
    for at in range(0, len(points), 2048):
        block = points[at : at + 2048]
        apart = (centre**2).sum(1) - 2 * block @ centre.T
        some = np.argpartition(apart, n - 1, axis=1)[:, :n] if n < len(centre) else np.tile(np.arange(len(centre)), (len(block), 1))
        out[at : at + 2048] = np.take_along_axis(some, np.argsort(np.take_along_axis(apart, some, 1), axis=1, kind="stable"), 1)
    return out


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and vec array<double> of the rows that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where("vec_id is not null and vec is not null and size(vec) > 0")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("vec", lambda x: x != 0))
    dims = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vec") == (dims[0] if dims else 0))


def distinct_points(vectors: DataFrame, k: int) -> DataFrame:
    """rep (smallest id), ids (the k + 1 smallest, in order), vec of every different vector. What is beyond them goes before the shuffle."""
    hashes = {f"h{i}": F.xxhash64(F.lit(i), "vec") for i in range(2)}
    same = Window.partitionBy("h0", "h1").orderBy("vec_id")
    few = vectors.withColumns(hashes).withColumn("r", F.dense_rank().over(same)).where(F.col("r") <= k + 1)
    once = few.withColumn("before", F.lag("vec_id").over(same)).where("before is null or before <> vec_id")
    return once.groupBy("h0", "h1").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("vec").alias("vec")).select(F.col("ids")[0].alias("rep"), "ids", "vec")


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, visit: float = VISIT) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest found. Both tables: vec_id, vec, as valid_vectors() gives them."""
    spark = vectors.sparkSession
    points = written(distinct_points(vectors, k), "points")
    count = points.count()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.stack(points.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vec").toPandas()["vec"].to_numpy()).astype(np.float64)
    centre = centroids(sample, max(1, min(MOST_LISTS, len(sample), int(np.sqrt(count)))))
    turn = rotation(sample.shape[1])
    turned_centre, dim, lists = centre @ turn, sample.shape[1], len(centre)

    def code(frames):
        for frame in frames:
            vec = np.stack(frame["vec"].to_numpy())
            near = nearest(vec, centre, 1)[:, 0]
            packed, length, match = encode(vec - centre[near], turn)
            whole = ((vec - centre[near]) @ turn).astype("<f4")
            yield pd.DataFrame({"list": near, "rep": frame["rep"], "code": [p.tobytes() for p in packed], "length": length, "match": match, "whole": [w.tobytes() for w in whole]})

    coded = written(points.select("rep", "vec").mapInPandas(code, "list int, rep long, code binary, length double, match double, whole binary"), "coded")
    size, shortest, longest = np.zeros(lists, np.int64), np.zeros(lists), np.zeros(lists)
    for r in coded.groupBy("list").agg(F.count("*"), F.min("length"), F.max("length")).collect():  # a row per list
        size[r[0]], shortest[r[0]], longest[r[0]] = r[1], r[2], r[3]
    parts = np.maximum(1, -(-size // min(LIST, max(LEAST, 2 * count // lists))))
    asked = written(queries.groupBy("vec_id").agg(F.min("vec").alias("vec")), "queries")

    def rows(name: np.ndarray, vec: np.ndarray, limit: np.ndarray, picked: np.ndarray) -> pd.DataFrame:
        who, where = np.nonzero(picked)
        packed, low, step, reach, off = squeeze((vec @ turn)[who] - turned_centre[where])
        return pd.DataFrame({"list": where, "query": name[who], "packed": [p.tobytes() for p in packed], "low": low, "step": step, "reach": reach, "off": off, "limit": limit[who]})

    def visits(frames, further: bool):
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                name, vec = part["vec_id"].to_numpy(np.int64), np.stack(part["vec"].to_numpy())
                order = nearest(vec, centre, lists)
                first = np.zeros((len(name), lists), bool)
                held = np.cumsum(size[order], axis=1)
                np.put_along_axis(first, order, np.concatenate((np.zeros((len(name), 1)), held[:, :-1]), axis=1) < CANDIDATES, 1)
                if not further:
                    yield rows(name, vec, np.full(len(name), np.inf), first & (size > 0))
                    continue
                limit = part["limit"].fillna(np.inf).to_numpy(np.float64)
                apart = np.sqrt(np.maximum((vec**2).sum(1)[:, None] + (centre**2).sum(1) - 2 * vec @ centre.T, 0))
                cosine = min(1.0, visit / np.sqrt(dim))
                length = np.clip(apart * cosine, shortest, longest)
                yield rows(name, vec, limit, ~first & (size > 0) & (apart**2 + length**2 - 2 * length * apart * cosine <= limit[:, None] ** 2))

    asks = "list int, query long, packed binary, low double, step double, reach double, off double, limit double"

    def meet(mine: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = []
        if len(mine) and len(ask):
            name = mine["rep"].to_numpy(np.int64)
            codes = np.frombuffer(b"".join(mine["code"]), np.uint8).reshape(len(mine), -1)
            length, match = mine["length"].to_numpy(), mine["match"].to_numpy()
            packed = np.frombuffer(b"".join(ask["packed"]), np.uint8).reshape(len(ask), -1)
            whole = np.frombuffer(b"".join(mine["whole"]), "<f4").reshape(len(mine), -1)
            who = ask["query"].to_numpy(np.int64)
            low, step, reach, off, limit = (ask[c].to_numpy(np.float64) for c in ("low", "step", "reach", "off", "limit"))
            bar = lambda high: np.partition(high, k)[k] if len(high) > k else np.inf
            for at in range(0, len(who), 64):
                cut = slice(at, at + 64)
                least, most = bounds(codes, length, match, (packed[cut], low[cut], step[cut], reach[cut], off[cut]))
                for i in range(len(least)):
                    q = at + i
                    some = np.flatnonzero(least[i] <= min(bar(most[i]), limit[q] ** 2 * (1 + 1e-9)))
                    apart = np.sqrt(((whole[some] - (packed[q] * step[q] + low[q]).astype(np.float32)) ** 2).sum(1, dtype=np.float64))
                    slack = off[q] + 1e-5 * (reach[q] + apart)
                    some = some[apart - slack <= min(bar(apart + slack), limit[q] * (1 + 1e-9))]
                    out.append((np.full(len(some), who[q]), name[some]))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 2
        return pd.DataFrame(dict(zip(["query", "rep"], cols)))

    def measured(table: DataFrame) -> DataFrame:
        """The candidates (query, ids, score) of a table of visits."""
        many = np.zeros(lists, np.int64)
        for r in table.groupBy("list").count().collect():  # a row per list
            many[r[0]] = r[1]
        cuts = [(i, int(parts[i]), int(-(-many[i] // QUERIES))) for i in np.flatnonzero(many).tolist()]
        shape = spark.createDataFrame(cuts, "list int, parts int, blocks int")  # a row per list
        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        ours = coded.join(F.broadcast(shape), "list").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("block", upto("blocks")).drop("parts", "blocks")
        theirs = table.join(F.broadcast(shape), "list").withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int")).withColumn("part", upto("parts")).drop("parts", "blocks")
        by = ["list", "part", "block"]
        found = ours.groupBy(*by).cogroup(theirs.groupBy(*by)).applyInPandas(meet, "query long, rep long")
        found = found.join(points, "rep").join(asked.select(F.col("vec_id").alias("query"), F.col("vec").alias("asked")), "query")
        return found.select("query", "rep", "ids", distance(F.col("vec"), F.col("asked")).alias("score"))

    def nearest_points(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "rep"))
        return found.withColumn("r", rank).where(F.col("r") <= k + 1)

    one = asked.mapInPandas(lambda frames: visits(frames, False), asks)
    near = written(nearest_points(measured(written(one, "visits"))), "near")
    limits = near.where(F.col("r") == k + 1).select(F.col("query").alias("vec_id"), F.col("score").alias("limit"))
    more = asked.join(limits, "vec_id", "left").mapInPandas(lambda frames: visits(frames, True), asks)
    found = nearest_points(near.drop("r").unionByName(measured(written(more, "visits"))))
    every = found.select(F.col("query").alias("query_id"), F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
