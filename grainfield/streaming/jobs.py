"""Structured Streaming jobs over event logs, page hashes and findings. Each takes and returns streaming DataFrames, or starts a query."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from grainfield.operators.tables import first_per_key


def event_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events per tumbling window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event", "n")


def distinct_content(pages: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first page of each (target, hash) within the watermark; of a batch, of all."""
    if not pages.isStreaming:
        return first_per_key(pages, ["target", "hash"], "ts")
    return pages.withWatermark("ts", late).dropDuplicatesWithinWatermark(["target", "hash"])


def liveness(beats: DataFrame, timeout: str = "2 minutes", late: str = "10 minutes") -> DataFrame:
    """A run's active spans: heartbeats no further apart than the timeout."""
    return beats.withWatermark("ts", late).groupBy(F.session_window("ts", timeout).alias("w"), "run").agg(F.count("*").alias("beats")).select("run", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "beats")


def rates(usage: DataFrame, late: str = "2 minutes") -> DataFrame:
    """T4: requests and tokens in sliding minutes."""
    return usage.withWatermark("ts", late).groupBy(F.window("ts", "60 seconds", "10 seconds")).agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens")).select(F.col("window.start").alias("start"), "requests", "tokens")


def daily_findings(findings: DataFrame, late: str = "1 hour") -> DataFrame:
    """T5: findings per day."""
    return findings.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "n")


def monthly_findings(findings: DataFrame, late: str = "32 days") -> DataFrame:
    """T5: findings per month; a month is given out when the months have moved on by the lateness."""
    months = findings.select(F.date_trunc("month", "ts").cast("timestamp").alias("month")).withWatermark("month", late)
    return months.groupBy("month").agg(F.count("*").alias("n"))


def liveness_changes(beats: DataFrame, timeout: str = "2 minutes", late: str = "10 minutes", clock: str = "event") -> DataFrame:
    """T3 as it happens: run, status, at: "active" with a run's first beat (run, ts), "inactive" as soon as none came for the timeout.

    A run's state is the time of its last beat and a timer. By the event clock the timer fires when the watermark passes it,
    whichever run's beats move that; by the processing clock after the timeout without a beat, also when no data come at all. A
    beat after that begins a new active span. Beats without a time are left out; late ones don't count.
    """
    wait = pd.Timedelta(timeout)
    by_event = clock == "event"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            out.append((key[0], "inactive", state.get[0] + wait))
            state.remove()
        else:
            last = state.get[0] if state.exists else None
            for ts in sorted(ts for frame in frames for ts in frame["ts"]):
                if last is None or by_event and ts > last + wait:
                    out += [] if last is None else [(key[0], "inactive", last + wait)]
                    out.append((key[0], "active", ts))
                    last = ts
                last = max(last, ts)
            if last is not None:
                state.update((last,))
                if by_event:
                    state.setTimeoutTimestamp(max(int((last + wait).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
                else:
                    state.setTimeoutDuration(int(wait.total_seconds() * 1000))
        if out:
            yield pd.DataFrame(out, columns=["run", "status", "at"])

    known = beats.where("ts is not null").withWatermark("ts", late).select("run", "ts").groupBy("run")
    timer = GroupStateTimeout.EventTimeTimeout if by_event else GroupStateTimeout.ProcessingTimeTimeout
    return known.applyInPandasWithState(step, f"run {beats.schema['run'].dataType.simpleString()}, status string, at timestamp", "last timestamp", "append", timer)


def _write_batches(found: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each batch is a folder of its own, written over if the batch runs again after a failure."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return found.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def page_changes(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Pages (target, url_key, hash, seen long) that are new or changed go to out, with is_new.

    A page's state is the hash it had last. A batch reads and writes the state of its own pages alone, however many came before
    it; the state and its progress lie in the checkpoint, so a batch that runs again starts from the state before it and leaves
    the same rows. Of a page that comes several times in a batch the last seen counts (ties: the greatest hash).
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = max((seen, hash) for frame in frames for seen, hash in zip(frame["seen"], frame["hash"]))
        if not state.exists or state.get[0] != now[1]:
            yield pd.DataFrame([(*key, now[1], not state.exists)], columns=["target", "url_key", "hash", "is_new"])
        state.update((now[1],))

    known = pages.select("target", "url_key", F.coalesce("hash", F.lit("")).alias("hash"), F.coalesce("seen", F.lit(0)).alias("seen")).groupBy("target", "url_key")
    changed = known.applyInPandasWithState(step, "target string, url_key string, hash string, is_new boolean", "hash string", "append", GroupStateTimeout.NoTimeout)
    return _write_batches(changed, out, checkpoint)


def insert_findings(findings: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Findings (ags, massnahme, start, pos) not yet stored, the first per key, go to the store.

    Whether a key (ags, lower-cased and trimmed massnahme, start; null-safe) is stored is its state: a batch looks at its own
    keys alone and never reads the store. Batches that run again leave the same rows, as in page_changes().
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if not state.exists:
            rows = pd.concat(list(frames))
            state.update((True,))
            yield rows.sort_values(["pos", "massnahme"])[:1][["ags", "massnahme", "start", "pos"]]

    keyed = findings.select("ags", "massnahme", "start", "pos", F.struct("ags", F.lower(F.trim("massnahme")).alias("m"), "start").alias("key")).groupBy("key")
    new = keyed.applyInPandasWithState(step, "ags string, massnahme string, start string, pos long", "stored boolean", "append", GroupStateTimeout.NoTimeout)
    return _write_batches(new, store, checkpoint)
