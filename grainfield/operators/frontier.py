"""Rounds of a crawl over a stored link table."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainfield.functions.urls import url_base
from grainfield.operators.tables import first_per_key


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir with a folder of this application's own; only on one machine (tests) it may be unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='grainfield-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """The rows read back from a table in the shared folder."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rules for a link's end of the queue: documents never go ahead, or always do, or nothing does. Any other column will do, too.
ORDERS = {"focused": "is_priority and not is_document", "documents_first": "is_priority or is_document", "fifo": "false"}


#: The links of so many pages are looked up by their keys; those of more are joined.
FEW = 1000


def _front(order: str | Column) -> Column:
    rule = order if isinstance(order, Column) else F.expr(ORDERS[order])
    return F.coalesce(rule.cast("boolean"), F.lit(False))


def frontier_round(links: DataFrame, visited: DataFrame, cap: int, order: str | Column = "focused", queue: DataFrame | None = None, once: bool = False) -> DataFrame:
    """The queues of all targets after the links of a page were put in: target, place (from 1, the next first), url.

    links: target, pos, url and what the order's rule needs (is_priority, is_document); visited: target, url; queue: target,
    place, url of what waits already. Links are taken as they stand (pos), without those whose page was visited, until the queue
    has `cap` entries. One for which the rule holds goes to the front, before those put there so far; any other to the end.
    With once, a link to a page that waits already, or stands before it among the links, is passed over; without, it waits twice.
    Equal pos: by url. Only the first `cap` links of a target can get in, so no more of them meet in one place.
    """
    key = url_base("url")
    fresh = links.select("target", "pos", "url", _front(order).alias("front"), key.alias("key")).join(visited.select("target", key.alias("key")).distinct(), ["target", "key"], "left_anti")
    waiting = queue.select("target", F.lit(1).alias("zone"), F.col("place").cast("long").alias("at"), "url") if queue is not None else None
    if once:
        fresh = first_per_key(fresh, ["target", "key"], "pos", "url")
        if waiting is not None:
            fresh = fresh.join(waiting.select("target", key.alias("key")).distinct(), ["target", "key"], "left_anti")
    line = Window.partitionBy("target")
    fresh = fresh.withColumn("n", F.row_number().over(line.orderBy("pos", "url"))).where(F.col("n") <= cap)
    if waiting is not None:
        fresh = fresh.join(waiting.groupBy("target").agg(F.count("*").alias("held")), "target", "left").where(F.col("n") + F.coalesce("held", F.lit(0)) <= cap)
    n = F.col("n").cast("long")
    put = fresh.select("target", F.when(F.col("front"), 0).otherwise(2).alias("zone"), F.when(F.col("front"), -n).otherwise(n).alias("at"), "url")
    every = put if waiting is None else put.unionByName(waiting)
    return every.select("target", F.row_number().over(line.orderBy("zone", "at")).alias("place"), "url")


def reach(edges: DataFrame, seeds: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """Node, level: least number of links from a seed; one join a round, each round written to the shared folder, until no new node comes."""
    found = shared_table(seeds.select("node").distinct().withColumn("level", F.lit(0)), "reach")
    last, level = found, 0
    while most_rounds is None or level < most_rounds:
        level += 1
        step = last.join(edges, last.node == edges.src).select(F.col("dst").alias("node")).distinct().join(found, "node", "left_anti")
        last = shared_table(step.withColumn("level", F.lit(level)), "reach")
        if last.isEmpty():
            break
        found = found.unionByName(last)
        if level % 8 == 0:
            found = shared_table(found, "reach")  # one table again, so that plans and files stay few
    return found


def bucketed_table(df: DataFrame, name: str, key: str) -> DataFrame:
    """The rows in a table of the shared folder that lies in buckets of a key, so that a join by the key doesn't shuffle it again."""
    spark = df.sparkSession
    label = f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", f"{shared_folder(spark)}/{label}").saveAsTable(label)
    return spark.table(label)


def rows_of(rows: DataFrame, key: str, values: list) -> DataFrame:
    """The rows with these keys, asked for ten at a time, as Spark hands no longer list on to Parquet: of a sorted file only the pages that may hold one are read."""
    values = sorted(values)
    tens = [F.col(key).isin(values[i : i + 10]) for i in range(0, len(values), 10)]
    while len(tens) > 1:
        tens = [reduce(or_, tens[i : i + 2]) for i in range(0, len(tens), 2)]
    return rows.where(tens[0])


def crawl(edges: DataFrame, seeds: DataFrame, budget: int, cap: int = 300, order: str | Column = "focused", pages: DataFrame | None = None, once: bool = False) -> DataFrame:
    """Target, place, node: the pages that every target's crawl reads, in its order, until its budget is spent or its queue empty; as crawls() with one order."""
    return crawls(edges, seeds, budget, cap, {"": order}, pages, once).drop("mode")


def crawls(edges: DataFrame, seeds: DataFrame, budget: int, cap: int, orders: dict[str, str | Column], pages: DataFrame | None = None, once: bool = False) -> DataFrame:
    """Mode, target, place, node: the pages that every target's crawl reads, once in each of the orders, which are run beside each other (at most 62).

    edges: src, dst, pos, and what the orders' rules need (is_priority, is_document, or any columns of a rule of one's own);
    seeds: target, node; nodes are urls in the form that tells pages apart. pages, if given: node, ok, hash; a page that isn't ok
    (blocked, failed, not stored) or whose hash the target has read before is passed over when its turn comes: it costs no budget
    and its links don't count. Queues work as in frontier_round(): links of a page go in as they stand while there is room.

    A target in an order is one row: its queue (at most cap entries and the seed), the pages seen and the pages read. Every round,
    each takes its next page, and its links are put into the queue by columns; links lie in sorted buckets of their page, so a
    round shuffles only the targets' rows, and reads only the links it needs while it needs those of FEW pages at most. Rounds,
    at most as many as the budget, are tables in the shared folder, so that none is done twice.
    """
    kind = edges.schema["dst"].dataType
    fronts = reduce(lambda a, b: a.bitwiseOR(b), [F.when(_front(o), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, o in enumerate(orders.values())])
    known = edges.select("src", "pos", F.col("dst").alias("node"), fronts.alias("fronts"))
    if pages is not None:
        known = known.join(pages.select("node", F.coalesce("ok", F.lit(False)).alias("ok"), F.col("hash").cast("string").alias("hash")), "node", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    else:
        known = known.withColumns({"ok": F.lit(True), "hash": F.lit(None).cast("string")})
    lists = known.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("pos", "node", "fronts", "ok", "hash"))).alias("links"))
    lists = bucketed_table(lists.select(F.col("src").alias("now"), "links"), "links", "now")
    entry = "struct<node:{0},ok:boolean,hash:string>".format(kind.simpleString())
    first = seeds.select("target", F.col("node").cast(kind).alias("node"))
    if pages is not None:
        first = first.join(pages.select("node", F.coalesce("ok", F.lit(False)).alias("ok"), F.col("hash").cast("string").alias("hash")), "node", "left")
    else:
        first = first.withColumns({"ok": F.lit(True), "hash": F.lit(None).cast("string")})
    none = F.array().cast(f"array<{kind.simpleString()}>")
    runs = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(1 << i).cast("long").alias("bit")) for i, m in enumerate(orders)]))
    first = first.withColumn("run", runs)
    state = first.select("run.*", "target", F.array(F.struct("node", F.coalesce("ok", F.lit(False)).alias("ok"), "hash")).cast(f"array<{entry}>").alias("queue"), none.alias("seen"), F.array().cast("array<string>").alias("hashes"), none.alias("read"))
    state = shared_table(state, "crawl")
    for _ in range(budget):
        fits = lambda e: e["ok"] & ~F.array_contains("seen", e["node"]) & ~F.coalesce(F.array_contains("hashes", e["hash"]), F.lit(False))
        at = F.array_position(F.transform("queue", fits), True).cast("int")  # 0: none left
        taken = state.withColumn("at", F.when(at > 0, at).otherwise(F.size("queue"))).withColumn("e", F.when(at > 0, F.get("queue", at - 1)))
        rest = F.slice("queue", F.col("at") + 1, F.greatest(F.size("queue") - F.col("at"), F.lit(0)))
        seen = F.array_union("seen", F.transform(F.slice("queue", 1, F.col("at")), lambda e: e["node"]))
        hashes = F.when(F.col("e.hash").isNotNull(), F.array_append("hashes", F.col("e.hash"))).otherwise(F.col("hashes"))
        read = F.when(F.col("e").isNotNull(), F.array_append("read", F.col("e.node"))).otherwise(F.col("read"))
        taken = taken.select("mode", "bit", "target", rest.alias("queue"), seen.alias("seen"), hashes.alias("hashes"), read.alias("read"), F.col("e.node").alias("now"))
        asked = [r.now for r in taken.where("now is not null").select("now").distinct().limit(FEW + 1).collect()]
        if not asked:
            break
        found = taken.join(lists if len(asked) > FEW else rows_of(lists, "now", asked), "now", "left")
        waits = F.transform("queue", lambda e: e["node"])
        fresh = F.filter(F.coalesce("links", F.array().cast(lists.schema["links"].dataType)), lambda x: ~F.array_contains("seen", x["node"]) & (~F.array_contains(waits, x["node"]) if once else F.lit(True)))
        if once:
            nodes = F.col("nodes")
            found = found.withColumn("fresh", fresh).withColumn("nodes", F.transform("fresh", lambda x: x["node"]))
            fresh = F.filter("fresh", lambda x, i: F.array_position(nodes, x["node"]) == i + 1)
        put = F.col("put")
        ahead = lambda x: x["fronts"].bitwiseAND(F.col("bit")) > 0
        found = found.withColumn("put", F.slice(fresh, 1, F.greatest(F.lit(cap) - F.size("queue"), F.lit(0))))
        plain = lambda xs: F.transform(xs, lambda x: F.struct(x["node"].alias("node"), x["ok"].alias("ok"), x["hash"].alias("hash")))
        queue = F.concat(plain(F.reverse(F.filter(put, ahead))), F.col("queue"), plain(F.filter(put, lambda x: ~ahead(x))))
        state = shared_table(found.select("mode", "bit", "target", queue.alias("queue"), "seen", "hashes", "read"), "crawl")
    return state.select("mode", "target", F.posexplode("read").alias("place", "node")).withColumn("place", F.col("place") + 1)


def harvest_at(visits: DataFrame, ks: list[int]) -> DataFrame:
    """Visits (scenario, place, is_relevant): share of relevant pages among the first k, per scenario."""
    rates = [F.round(F.coalesce(F.try_divide(F.count_if(F.col("is_relevant") & (F.col("place") <= k)), F.count_if(F.col("place") <= k)), F.lit(0.0)), 4).alias(f"hr_at_{k}") for k in ks]
    return visits.groupBy("scenario").agg(*rates)


def bfs_sql(spark: SparkSession, edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """The same levels as one recursive query."""
    return spark.sql(
        "WITH RECURSIVE r AS (SELECT node, 0 AS level FROM {seeds} UNION ALL SELECT dst, level + 1 FROM r JOIN {edges} ON src = node WHERE level < {most}) SELECT node, min(level) AS level FROM r GROUP BY node",
        edges=edges, seeds=seeds, most=most,
    )
