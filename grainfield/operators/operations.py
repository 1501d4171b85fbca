"""Windows over logs: running costs, rate limits, crawl delays, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _buckets(df: DataFrame, value: Column, ts: str, part: list[Column], seconds: int) -> tuple[DataFrame, DataFrame]:
    """The rows with _bucket (pieces of time within a part), and per bucket the sum of the earlier ones of its part (_before)."""
    rows = df.withColumns({f"_p{i}": c for i, c in enumerate(part)}).withColumn("_bucket", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000)))
    names = [f"_p{i}" for i in range(len(part))]
    sums = rows.groupBy(*names, "_bucket").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return rows, sums.select(*names, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))


def prefix_sums(df: DataFrame, value: str, ts: str, tie: str, out: str, seconds: int = 600) -> DataFrame:
    """Running total over the whole table in time order: sums per piece of time first, then within each.

    Only the pieces' sums meet in one place (ten minutes: 53,000 a year), so the rows themselves are never sorted in a
    single task; rows must have a time.
    """
    rows, before = _buckets(df, F.col(value), ts, [], seconds)
    inner = Window.partitionBy("_bucket").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(before, "_bucket").withColumn(out, F.col("_before") + F.sum(value).over(inner)).drop("_bucket", "_before")


def daily_counter(df: DataFrame, ts: str, tie: str, out: str, seconds: int = 600) -> DataFrame:
    """Number of the row within its day, by pieces of the day as in prefix_sums()."""
    rows, before = _buckets(df, F.lit(1), ts, [F.to_date(ts)], seconds)
    inner = Window.partitionBy("_p0", "_bucket").orderBy(ts, tie)
    return rows.join(before, ["_p0", "_bucket"]).withColumn(out, (F.col("_before") + F.row_number().over(inner)).cast("int")).drop("_p0", "_bucket", "_before")


def crawl_delay_audit(visits: DataFrame, least: float, seconds: int = 3600) -> DataFrame:
    """Seconds since the last visit to the host, and whether that kept the delay.

    A host's visits are dealt by pieces of time; the first of a piece looks back at the last one of the host's piece before, of
    which only its time is carried over. So a host with any share of the rows is many tasks. Visits without a time are one piece.
    """
    rows = visits.withColumn("_piece", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000)))
    ends = rows.groupBy("host", "_piece").agg(F.max("ts").alias("_end"))
    ends = ends.select(F.col("host").alias("_host"), F.col("_piece").alias("_p"), F.lag("_end").over(Window.partitionBy("host").orderBy("_piece")).alias("_edge"))
    inner = Window.partitionBy("host", "_piece").orderBy("ts", "pos")
    rows = rows.withColumns({"_n": F.row_number().over(inner), "_before": F.lag("ts").over(inner)})
    rows = rows.join(ends, F.col("host").eqNullSafe(F.col("_host")) & F.col("_piece").eqNullSafe(F.col("_p")), "left")
    gap = F.timestamp_diff("SECOND", F.when(F.col("_n") == 1, F.col("_edge")).otherwise(F.col("_before")), F.col("ts"))
    return rows.withColumn("gap_seconds", gap).withColumn("too_early", F.coalesce(F.col("gap_seconds") < least, F.lit(False))).select(*visits.columns, "gap_seconds", "too_early")


def rate_windows(usage: DataFrame, seconds: int, requests: int, tokens: int, key: str = "ort") -> DataFrame:
    """Per key, requests and tokens of the last seconds at each request, and whether a limit was broken; the day's number of
    the request; and whether it was too large by itself.

    A key's requests are dealt by pieces of time as long as the window; each counts in its own piece and, carried over, in the
    next one, so that a window lies within a piece and a key with any share of the rows is many tasks.
    """
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    piece = F.floor(F.col("_at") / seconds)
    rows = usage.withColumn("_at", at).withColumn("_piece", F.explode(F.array(piece, piece + 1)))
    back = Window.partitionBy(key, "_piece").orderBy("_at").rangeBetween(-seconds + 1, 0)
    rows = rows.withColumns({"window_requests": F.count("*").over(back), "window_tokens": F.sum("tokens").over(back)}).where(piece == F.col("_piece")).drop("_at", "_piece")
    names = ["_p0", "_p1", "_bucket"]
    rows, before = _buckets(rows, F.lit(1), "ts", [F.col(key), F.to_date("ts")], 600)
    within = Window.partitionBy(*names).orderBy("ts", "id")
    before = before.select(*[F.col(c).alias(f"_j{c}") for c in names], "_before")
    same = [F.col(c).eqNullSafe(F.col(f"_j{c}")) for c in names]
    rows = rows.withColumn("_n", F.row_number().over(within)).join(before, same[0] & same[1] & same[2], "left")
    rows = rows.withColumns({"oversize": F.col("tokens") >= tokens, "day_request": (F.col("_before") + F.col("_n")).cast("int")})
    return rows.withColumn("over_limit", (F.col("window_requests") > requests) | (F.col("window_tokens") > tokens)).select(*usage.columns, "oversize", "window_requests", "window_tokens", "day_request", "over_limit")


def session_totals(usage: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Cost (what can't be read counts 0) and requests."""
    return usage.groupBy(*by).agg(F.round(F.sum(F.coalesce(F.col("cost").try_cast("double"), F.lit(0.0))), 6).alias("cost"), F.count("*").alias("requests"))


def cost_lines(running: DataFrame) -> DataFrame:
    """One text line per request of prefix_sums(): its cost and the total so far."""
    at = F.date_format("ts", "dd.MM.yyyy HH:mm:ss")
    return running.select(F.format_string("[%s] %s | Kosten: %.8f $ | Session: %.6f $", at, F.col("ort").cast("string"), F.col("cost"), F.col("total")).alias("value"))


def effective_delay(robots: Column, default: float, most: float | None = None) -> Column:
    """the longer of the host's delay and the default, within bounds if there is a greatest delay."""
    longer = F.greatest(F.coalesce(robots, F.lit(default)), F.lit(default))
    return longer if most is None else F.greatest(F.lit(0.0), F.least(longer, F.lit(most)))


def within_budget(visits: DataFrame, key: str, most: int, *order: Column | str) -> DataFrame:
    """The first pages of every target, up to its budget."""
    return visits.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= most)


def harvest_counts(pages: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Per target the pages read, those unchanged since the stored hash, and those whose content occurred before."""
    rows = pages.join(stored.select(key, "url_key", F.col("hash").alias("old")), [key, "url_key"], "left")
    return rows.groupBy(key).agg(F.count("*").alias("pages"), F.count_if(F.col("hash") == F.col("old")).alias("unchanged"), (F.count("hash") - F.count_distinct("hash")).alias("duplicates"))


def outcome(status: str = "status"):
    """Class of a status."""
    s = F.col(status)
    return F.when(s == "OK", "ok").when(s.isin("ROBOTS", "SENSITIVE"), "skipped").when(s.startswith("EXTERNAL_REDIRECT"), "redirect").when(s == "DNS_TIMEOUT", "timeout").when(s.startswith("HTTP_"), "http_error").otherwise("error")


def dominant_status(log: DataFrame) -> DataFrame:
    """Per target the most frequent failure, the first seen on ties, UNKNOWN if it has none."""
    counts = log.groupBy("target", "status").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    bad = F.col("status") != "OK"
    best = F.max_by(F.when(bad, F.col("status")), F.when(bad, F.struct("n", (-F.col("first")).alias("f"))))
    return counts.groupBy("target").agg(F.coalesce(best, F.lit("UNKNOWN")).alias("dominant"))


def run_summary(log: DataFrame) -> DataFrame:
    """Processed, succeeded, redirected, failed."""
    kind = outcome()
    return log.agg(F.count("*").alias("processed"), F.count_if(kind == "ok").alias("success"), F.count_if(kind == "redirect").alias("redirects"), F.count_if(kind.isin("http_error", "timeout", "error")).alias("errors"))
