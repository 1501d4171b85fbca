"""Filtered, paged and aggregated views of targets and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = "Alle"


def equal_filters(**values: str | None) -> Column:
    """Equality of every given value that is not the sentinel, all together."""
    out = F.lit(True)
    for name, value in values.items():
        if value not in (None, ALL):
            out = out & (F.col(name) == value)
    return out


def search_filter(term: str, *columns: str) -> Column:
    """The term in any of the columns, ignoring case; null columns don't match."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False))
    return out


def scan_status(status: str | None) -> Column:
    """P2."""
    return F.col("last_scanned").isNotNull() if status == "done" else F.col("last_scanned").isNull() if status == "pending" else F.lit(True)


def with_targets(findings: DataFrame, targets: DataFrame, how: str = "left") -> DataFrame:
    """Findings with place and state of their target, keys as text."""
    t = targets.select(F.col("ags").cast("string").alias("_ags"), "ort", "bundesland")
    return findings.join(t, F.col("ags").cast("string") == F.col("_ags"), how).drop("_ags")


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """O1, O2: one page; the order should end with a unique column."""
    return df.orderBy(*order).offset((max(1, number) - 1) * min(max(size, 1), 500)).limit(min(max(size, 1), 500))


def findings_page(findings: DataFrame, targets: DataFrame, number: int, size: int, term: str | None = None, newest: bool = True, **equal: str | None) -> DataFrame:
    rows = with_targets(findings.where("massnahme is not null"), targets).where(equal_filters(**equal))
    if term:
        rows = rows.where(search_filter(term, "massnahme", "adresse", "ort"))
    order = F.col("end_time").desc_nulls_first() if newest else F.col("end_time").asc_nulls_last()
    return page(rows, number, size, order, F.col("id")).select("id", "ags", "ort", "bundesland", "massnahme", "kategorie", "end_time")


def target_stats(targets: DataFrame, month: str) -> DataFrame:
    """A2: total, done since the month began, pending; one pass."""
    done = F.count_if(F.col("last_scanned") >= F.date_trunc("month", F.lit(month).cast("timestamp_ntz")))
    return targets.agg(F.count("*").alias("total"), done.alias("done"), (F.count("*") - done).alias("pending"))


def finding_stats(findings: DataFrame, now: str) -> DataFrame:
    """A3, P5: findings in all, since the month and since midnight."""
    at = F.lit(now).cast("timestamp_ntz")
    counts = [F.count_if(F.col("gefunden_am") >= F.date_trunc(unit, at)).alias(name) for unit, name in (("month", "this_month"), ("day", "today"))]
    return findings.where("massnahme is not null").agg(F.count("*").alias("total"), *counts)


def due_targets(targets: DataFrame, regions: DataFrame, preferred: str | None, n: int) -> DataFrame:
    """The preferred region first, then the longest unscanned; n of 0 means all."""
    rows = targets.join(regions, "bundesland", "left")
    order = [F.when(F.col("region") == preferred, 0).otherwise(1)] if preferred else []
    rows = rows.orderBy(*order, F.col("last_scanned").asc_nulls_first(), "ags")
    out = rows.select("ags", F.coalesce("url_redirect", "url").alias("url"), "bundesland", "region", "last_scanned")
    return out.limit(n) if n else out


def changelog(versions: DataFrame, items: DataFrame) -> DataFrame:
    """Each version with its items as ordered JSON, null without items."""
    item = F.struct("sort_order", F.struct(F.col("type").alias("tag"), "scope", F.col("message").alias("description")).alias("i"))
    nested = items.where("changelog_id is not null").groupBy("changelog_id").agg(F.array_sort(F.collect_list(item)).alias("a"))
    nested = nested.select("changelog_id", F.to_json(F.transform("a", lambda x: x["i"]), {"ignoreNullFields": "false"}).alias("items"))
    return versions.join(nested, versions.id == nested.changelog_id, "left").select("version", "release_date", "title", "items")


def version_flags(versions: DataFrame) -> DataFrame:
    """which version is the current one (the latest, of equal dates the one of greatest id) and which the first."""
    at = F.struct("release_date", "id")
    ends = versions.agg(F.max_by("id", at).alias("last_id"), F.min_by("id", at).alias("first_id"))
    rows = versions.crossJoin(F.broadcast(ends))  # one row
    return rows.select("id", "version", (F.col("id") == F.col("last_id")).alias("is_current"), (F.col("id") == F.col("first_id")).alias("is_first"))


def status_view(beats: DataFrame, now: str, timeout: int) -> DataFrame:
    """Per target the latest heartbeat, its age and the effective status."""
    last = beats.groupBy("message").agg(F.max("created_at").alias("last_heartbeat"), F.max_by("event_type", F.struct("created_at", "id")).alias("status"))
    age = F.timestamp_diff("SECOND", F.col("last_heartbeat"), F.lit(now).cast("timestamp_ntz")).cast("int")
    return last.withColumn("age_seconds", age).withColumn("effective", F.when(age > timeout, "inactive").otherwise("active"))


def geocode_requests(findings: DataFrame, targets: DataFrame, country: str = "Deutschland") -> DataFrame:
    """Requests for findings without coordinates."""
    rows = with_targets(findings.where("lat is null and massnahme is not null"), targets, "inner")
    exact = F.length(F.coalesce("adresse", F.lit(""))) > 5
    street = F.concat_ws(", ", "adresse", "ort", "bundesland")
    return rows.select("id", F.when(exact, street).otherwise(F.concat_ws(", ", "ort", "bundesland", F.lit(country))).alias("request"), F.when(exact, "street").otherwise("city").alias("level"))
