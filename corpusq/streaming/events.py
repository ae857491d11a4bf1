"""Progress, idle streams, answer tokens, sessions and event logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusq.functions.text import let
from corpusq.operators.running import next_value
from corpusq.session import use_rocksdb
from corpusq.sources.tables import parse_progress


def progress_until_done(raw: DataFrame, key: str = "job_id", seq: str = "seq", text: str = "data") -> DataFrame:
    """Messages of each job up to and including its first ``done``."""
    parsed = parse_progress(raw, text)
    ends = parsed.where("kind = 'done'").groupBy(key).agg(F.min(seq).alias("_end"))
    return (
        parsed.join(ends, key, "left")
        .where(F.col("_end").isNull() | (F.col(seq) <= F.col("_end")))
        .drop("_end")
    )


def progress_stream(raw: DataFrame, key: str = "job_id", seq: str = "seq", text: str = "data") -> DataFrame:
    """The same on a stream; the state of a job is one flag."""
    parsed = parse_progress(raw, text).select(key, seq, "kind", "stage", "percent", "message")

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            return
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(seq)
        done = (pdf["kind"] == "done").to_numpy()
        if done.any():
            pdf = pdf.iloc[: int(done.argmax()) + 1]
            state.update((True,))
        yield pdf

    return parsed.groupBy(key).applyInPandasWithState(
        step, parsed.schema, "done boolean", "append", GroupStateTimeout.NoTimeout
    )


def idle_timeouts(
    events: DataFrame,
    key: str,
    ts: str,
    seconds: int = 30,
    until: Column | None = None,
    bucket_seconds: int = 3600,
) -> DataFrame:
    """First idle gap per stream: one ``idle_timeout`` row, after which it is closed.

    A stream that is silent from its last event to ``until`` times out as well.
    """
    at = F.col(ts).cast("timestamp")
    timed = events.select(key, at.alias("_ts"))
    spaced = next_value(
        timed, [key], "_ts", F.floor(F.unix_timestamp("_ts") / bucket_seconds), "_next"
    )
    limit = F.make_interval(secs=F.lit(seconds))
    idle = F.coalesce("_next", until) if until is not None else F.col("_next")
    return (
        spaced.where(idle > F.col("_ts") + limit)
        .groupBy(key)
        .agg((F.min("_ts") + limit).alias("timed_out_at"))
        .withColumn("error", F.lit("idle_timeout"))
    )


def idle_timeouts_stream(
    events: DataFrame, key: str, ts: str, seconds: int = 30, *, delay: str
) -> DataFrame:
    """The same on a stream, in event time, whatever order the events arrive in.

    A gap of more than ``seconds`` cannot lie inside a bucket of that length, so events are first
    reduced to their first and last time per key and bucket, combined before the shuffle. Once
    the watermark has passed a bucket it goes to the state of its key: the last time seen, and
    whether the stream is closed. A key with most of the events sends one row per bucket.

    A stream has timed out when the watermark has passed the bucket in which its next event
    would have been due: silence to the end of the input counts only up to there. ``delay`` is
    how late an event may come (an interval such as "2 hours"). Spark leaves out rows behind
    that watermark and counts them in the progress of the query as numRowsDroppedByWatermark;
    choose it from the source's own delays.
    """
    out = T.StructType(
        [T.StructField(key, events.schema[key].dataType), T.StructField("_at", T.LongType())]
    )
    width, name = seconds * 1_000_000, key

    class Idle(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.seen = handle.getValueState("seen", "last long, due long, closed boolean")

        def _close(self, own, last: int) -> pd.DataFrame:
            self.seen.update((last, None, True))
            return pd.DataFrame({name: [own[0]], "_at": [last + width]})

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            last, due, closed = self.seen.get() if self.seen.exists() else (None, None, False)
            if closed:
                return
            buckets = sorted(pair for b in rows for pair in zip(b["first_t"].tolist(), b["last_t"].tolist(), strict=True))
            if due is not None:
                self.handle.deleteTimer(due)
            for first, end in buckets:
                if last is not None and first > last + width:
                    yield self._close(key, last)
                    return
                last = end
            # The bucket in which the next event is due ends here; it may still hold one until then.
            due = ((last + width) // width + 1) * seconds * 1000
            self.handle.registerTimer(due)
            self.seen.update((last, due, False))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            last, due, closed = self.seen.get() if self.seen.exists() else (None, None, True)
            if not closed and due == expiredTimerInfo.getExpiryTimeInMs():
                yield self._close(key, last)

        def close(self) -> None:
            pass

    use_rocksdb(events.sparkSession)
    bucket = F.window("_event_time", f"{seconds} seconds")
    reduced = (
        events.withColumn("_event_time", F.col(ts).cast("timestamp"))
        .withWatermark("_event_time", delay)
        .withColumn("_t", F.unix_micros("_event_time"))
        .groupBy(key, bucket.alias("_w"))
        .agg(F.min("_t").alias("first_t"), F.max("_t").alias("last_t"))
    )
    return (
        reduced.select(key, "first_t", "last_t", F.window_time("_w").alias("_event_time"))
        .groupBy(key)
        .transformWithStateInPandas(Idle(), out, "Append", "EventTime")
        .select(key, F.timestamp_micros("_at").alias("timed_out_at"), F.lit("idle_timeout").alias("error"))
    )


def assemble_tokens(events: DataFrame, key: str = "answer_id", seq: str = "seq") -> DataFrame:
    """Answer text from its token events, its citations, and how it ended.

    An answer is bounded by the token budget of one completion.
    """
    token = F.when(F.col("type") == "token", F.struct(seq, "text"))
    return events.groupBy(key).agg(
        F.array_join(F.sort_array(F.collect_list(token))["text"], "").alias("answer"),
        F.max(F.when(F.col("type") == "citations", F.col("text"))).alias("citations"),
        F.max_by("type", seq).alias("ended_with"),
    )


def active_sessions(events: DataFrame, revoked: DataFrame, ts: str = "ts") -> DataFrame:
    """Events whose token is not revoked at that time.

    ``revoked``: token_id, revoked_at, ttl_seconds. An entry without time to live was
    never stored. ``events`` may be a stream.
    """
    stored = revoked.where("ttl_seconds > 0").select(
        F.col("token_id").alias("_token"),
        F.col("revoked_at").alias("_from"),
        (F.col("revoked_at") + F.make_interval(secs=F.col("ttl_seconds"))).alias("_to"),
    )
    blocked = (
        (F.col("token_id") == F.col("_token")) & (F.col(ts) >= F.col("_from")) & (F.col(ts) < F.col("_to"))
    )
    return events.join(stored, blocked, "left_anti")


def parse_event_log(logs: DataFrame, text: str = "log") -> DataFrame:
    """Event blocks of a text log: name and JSON data in order.

    The last block counts only if its blank line is there; a block without name or
    data, or with data that is no JSON, is dropped.
    """
    others = [c for c in logs.columns if c != text]
    blocks = F.split(F.col(text), "\n\n")
    complete = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def event(block: Column) -> Column:
        lines = F.split(block, "\n")
        names = F.filter(lines, lambda line: F.startswith(line, F.lit("event:")))
        data = F.filter(lines, lambda line: F.startswith(line, F.lit("data:")))
        return let(
            F.struct(
                F.trim(F.substring(F.try_element_at(names, F.lit(-1)), 7, 1 << 30)).alias("name"),
                F.when(
                    F.size(data) > 0,
                    F.array_join(F.transform(data, lambda d: F.trim(F.substring(d, 6, 1 << 30))), "\n"),
                ).alias("data"),
            ),
            lambda e: e,
        )

    rows = logs.select(*others, F.posexplode(F.transform(complete, event)).alias("n", "e"))
    return rows.where(
        (F.coalesce(F.col("e.name"), F.lit("")) != "") & F.try_parse_json(F.col("e.data")).isNotNull()
    ).select(*others, (F.col("n") + 1).alias("seq"), F.col("e.name").alias("name"), F.col("e.data").alias("data"))
