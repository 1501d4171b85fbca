"""Writes to keyed tables, as DataFrames of the table afterwards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: Sequence[str | Column], *order: Column | str) -> DataFrame:
    """The first row of each key in an order that should end with a unique column. Equal keys are reduced where they lie before they are shuffled."""
    names = [f"_k{i}" for i in range(len(key))]
    rank = [o if isinstance(o, Column) else F.col(o) for o in order]
    keyed = df.withColumns(dict(zip(names, [k if isinstance(k, Column) else F.col(k) for k in key])))
    ranks = [f"_o{i}" for i in range(len(rank))]
    keyed = keyed.withColumns(dict(zip(ranks, rank)))
    least = keyed.groupBy(*names).agg(F.min(F.struct(*ranks, *df.columns)).alias("_r"))
    return least.select(*[F.col(f"_r.`{c}`").alias(c) for c in df.columns])


def first_rows(df: DataFrame, key: str, most: int, *order: str) -> DataFrame:
    """The first `most` rows of each key, with their number `_n`. A key with any share of the rows is cut down in many tasks first."""
    parts = [F.pmod(F.xxhash64(*order), F.lit(64)).alias("_salt")]
    cut = df.select("*", *parts).withColumn("_n", F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order))).where(F.col("_n") <= most).drop("_salt")
    return cut.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= most)


def upsert(base: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """K1-K3: rows of base without a match in new, and the rows of new (whose keys are unique)."""
    return base.join(new.select(*key), list(key), "left_anti").unionByName(new)


def latest_per_key(df: DataFrame, key: Sequence[str], *latest: str) -> DataFrame:
    """K1: of each key the row with the greatest order columns."""
    out = df.groupBy(*key).agg(F.max(F.struct(*latest, *[c for c in df.columns if c not in latest and c not in key])).alias("_r"))
    return out.select(*[F.col(c) if c in key else F.col(f"_r.`{c}`").alias(c) for c in df.columns])


def insert_if_absent(store: DataFrame, batch: DataFrame, key: dict[str, Column], *order: str) -> DataFrame:
    """Rows of batch, the first per key, whose key (null-safe) is not in the store. key: name to expression on both."""
    new = first_per_key(batch, list(key.values()), *order).withColumns({f"_n_{k}": e for k, e in key.items()})
    old = store.select(*[e.alias(f"_s_{k}") for k, e in key.items()])
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"_n_{k}").eqNullSafe(F.col(f"_s_{k}"))
    return new.join(old, same, "left_anti").select(*batch.columns)


def add_columns(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Missing columns with type and default; running it again changes nothing."""
    return df.withColumns({c: F.lit(v).cast(t) for c, (t, v) in defaults.items() if c not in df.columns})


def apply_updates(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Columns of updates replace those of base where they are not null; keys of updates are unique."""
    names = [c for c in updates.columns if c != key]
    joined = base.join(updates.select(key, *[F.col(c).alias(f"_u_{c}") for c in names]), key, "left")
    return joined.select(*[F.coalesce(F.col(f"_u_{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in base.columns])


def status_row(events: DataFrame, key: str) -> DataFrame:
    """K6: per crawler its status row after all events (ts, pos, event: active, inactive or heartbeat; target).

    The last start or stop gives status, started_at and stopped_at (null while active); heartbeats and starts give the
    heartbeat; the target is that of the last event, null after a stop.
    """
    at = F.struct("ts", "pos")
    turn, start, stop, beat = (F.col("event").isin(*names) for names in (("active", "inactive"), ("active",), ("inactive",), ("active", "heartbeat")))
    latest = lambda value, when: F.max_by(F.when(when, value), F.when(when, at))
    out = events.groupBy(key).agg(
        F.coalesce(latest(F.col("event"), turn), F.lit("inactive")).alias("status"), F.max(F.when(start, F.col("ts"))).alias("started_at"), latest(F.when(stop, F.col("ts")), turn).alias("stopped_at"),
        F.max(F.when(beat, F.col("ts"))).alias("last_heartbeat"), F.max_by(F.when(beat, F.col("target")), at).alias("current_target"),
    )
    return out


def insert_default(store: DataFrame, row: DataFrame, key: str) -> DataFrame:
    """K5: the default row too, unless its key is there."""
    return store.unionByName(row.join(store.select(key), key, "left_anti").select(*store.columns))


def by_key(df: DataFrame, key: str, value: object) -> DataFrame:
    """Always one row: found, and the columns of the row with this key, null if there is none."""
    one = df.where(F.col(key) == value).limit(1).withColumn("found", F.lit(True))
    asked = df.sparkSession.range(1).select(F.lit(value).cast(df.schema[key].dataType).alias("asked"))
    return asked.join(one, F.col("asked") == F.col(key), "left").withColumn("found", F.coalesce("found", F.lit(False)))


def forced(df: DataFrame, key: str, include: list[object], exclude: list[object]) -> DataFrame:
    """With lists of keys: the included ones first and always, the excluded ones never; `forced` tells."""
    inside = F.col(key).isin(include) if include else F.lit(False)
    outside = F.col(key).isin(exclude) if exclude else F.lit(False)
    return df.where(inside | ~outside).withColumn("forced", inside)


def error_bookkeeping(targets: DataFrame, outcomes: DataFrame) -> DataFrame:
    """K9: outcomes (ags, ok, code): success clears the code and count, failure sets the code and counts on; others stay."""
    rows = targets.join(outcomes, "ags", "left")
    code = F.when(F.col("ok"), None).when(~F.col("ok"), F.col("code")).otherwise(F.col("crawl_error_code"))
    count = F.when(F.col("ok"), 0).when(~F.col("ok"), F.coalesce("crawl_error_count", F.lit(0)) + 1).otherwise(F.col("crawl_error_count"))
    return rows.select("ags", code.alias("crawl_error_code"), count.cast("int").alias("crawl_error_count"))


def split_rejected(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that can be stored, and the others."""
    ok = F.coalesce(valid, F.lit(False))
    return df.where(ok), df.where(~ok)


def keep_newest(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The newest rows of a log, as a top-n (no window over the whole log)."""
    return df.orderBy(*order).limit(n)


def history_text(df: DataFrame, n: int) -> DataFrame:
    """The latest n lines, oldest last, as one text."""
    top = keep_newest(df, n, F.col("created_at").desc(), F.col("id").desc())
    line = F.concat(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), "event_type", F.lit("] "), "message")
    lines = top.agg(F.sort_array(F.collect_list(F.struct("created_at", "id", line.alias("line"))), asc=False).alias("a"))
    return lines.select(F.array_join(F.transform("a", lambda x: x["line"]), "\n").alias("text"))


def window_rank(df: DataFrame, part: Sequence[str], *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order)))
