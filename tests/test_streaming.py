"""Rate limits, progress, idle streams, sessions: batch, stream and plain loops agree."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corpusq.operators import metrics
from corpusq.operators.running import next_value, running_number, running_total
from corpusq.streaming import events as ev
from corpusq.streaming import rate_limit as rl

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def hits(spark, times):
    rows = [(k, i, at(s)) for i, (k, s) in enumerate(times)]
    return spark.createDataFrame(rows, "path string, event_id long, ts timestamp")


def plain_limit(times, limit, width):
    state, out = {}, {}
    for i, (k, s) in sorted(enumerate(times), key=lambda x: (x[1][1], x[0])):
        start, n = state.get(k, (None, 0))
        if start is None or s >= start + width:
            start, n = s, 0
        state[k] = (start, n + 1)
        out[i] = (n + 1, n + 1 <= limit)
    return out


def test_fourth_hit_is_rejected_and_paths_are_independent(spark):
    times = [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0), ("b", 1)]
    rows = rl.rate_limit(hits(spark, times), ["path"], "ts", "event_id", 3).orderBy("event_id").collect()
    assert [r.allowed for r in rows] == [True, True, True, False, True, True]
    assert [r.retry_after for r in rows] == [None, None, None, 60, None, None]


def test_a_hit_exactly_at_the_end_opens_a_new_window(spark):
    times = [("a", 0), ("a", 59.999), ("a", 60)]
    rows = rl.rate_limit(hits(spark, times), ["path"], "ts", "event_id", 1).orderBy("event_id").collect()
    assert [r.hit for r in rows] == [1, 2, 1]


@pytest.mark.parametrize(("span", "bucket", "fan"), [(4000, 60, 2), (4000, 60, 3), (3000, 120, 64), (900, 3600, 64)])
def test_chain_cut_into_buckets_equals_a_loop(spark, monkeypatch, span, bucket, fan):
    monkeypatch.setattr(rl, "FAN_OUT", fan)
    rng = random.Random(span + bucket + fan)
    times = [("hot", rng.random() * span) for _ in range(300)]
    times += [("quiet", rng.random() * span) for _ in range(12)] + [("even", n * 30.0) for n in range(span // 30)]
    df = rl.rate_limit(hits(spark, times), ["path"], "ts", "event_id", 4, bucket_seconds=bucket)
    # Times are stored in microseconds, so the loop has to see the same.
    rounded = [(k, round(s, 6)) for k, s in times]
    assert {r.event_id: (r.hit, r.allowed) for r in df.collect()} == plain_limit(rounded, 4, 60)


def stream_rows(spark, tmp_path, batches, build):
    """Write each batch as one file and read them one file per micro-batch."""
    folder = tmp_path / "in"
    for n, df in enumerate(batches):
        df.coalesce(1).write.mode("append").parquet(f"{folder}/b={n}")
    stream = (
        spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true").parquet(str(folder))
    )
    job = (
        build(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    job.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_stream_gives_the_batch_decisions(spark, tmp_path):
    rng = random.Random(1)
    times = sorted([("a", rng.random() * 500) for _ in range(80)] + [("b", rng.random() * 500) for _ in range(20)], key=lambda x: x[1])
    df = hits(spark, times)
    parts = [df.where(F.col("event_id").between(25 * n, 25 * n + 24)) for n in range(4)]
    rows = stream_rows(spark, tmp_path, parts, lambda s: rl.rate_limit_stream(s, ["path"], "ts", "event_id", 4, delay="10 minutes"))
    want = rl.rate_limit(df, ["path"], "ts", "event_id", 4).collect()
    assert {(r.event_id, r.hit, r.allowed) for r in rows} == {(r.event_id, r.hit, r.allowed) for r in want}


def progress(spark):
    rows = [
        (1, 1, '{"stage":"parse","percent":10.5}'), (1, 2, '{"stage":"embed","message":"m"}'), (1, 3, '{"event":"done"}'),
        (1, 4, '{"stage":"late"}'), (1, 5, '{"event":"done"}'), (2, 1, '{"stage":"parse","percent":null}'),
    ]
    return spark.createDataFrame(rows, "job_id long, seq long, data string")


def test_progress_stops_at_the_first_done(spark, tmp_path):
    df = progress(spark)
    want = {(1, 1, "progress", 10.5), (1, 2, "progress", None), (1, 3, "done", None), (2, 1, "progress", None)}
    got = {(r.job_id, r.seq, r.kind, r.percent) for r in ev.progress_until_done(df).collect()}
    assert got == want
    parts = [df.where("seq <= 2"), df.where("seq > 2")]
    rows = stream_rows(spark, tmp_path, parts, ev.progress_stream)
    assert {(r.job_id, r.seq, r.kind, r.percent) for r in rows} == want


def test_idle_streams_time_out_once(spark, tmp_path):
    times = [("a", 0), ("a", 10), ("a", 50), ("a", 200), ("b", 0), ("b", 30), ("b", 60), ("c", 0)]
    df = hits(spark, times)
    rows = ev.idle_timeouts(df, "path", "ts", 30, bucket_seconds=20).collect()
    assert {(r.path, r.timed_out_at) for r in rows} == {("a", at(40))}
    rows = ev.idle_timeouts(df, "path", "ts", 30, until=F.lit(at(300)), bucket_seconds=20).collect()
    assert {(r.path, r.timed_out_at) for r in rows} == {("a", at(40)), ("b", at(90)), ("c", at(30))}
    parts = [df.where("path <> 'z'"), hits(spark, [("later", 2000)]), hits(spark, [("later", 2001)])]
    rows = stream_rows(spark, tmp_path, parts, lambda s: ev.idle_timeouts_stream(s, "path", "ts", 30, delay="10 minutes"))
    got = {(r.path, r.timed_out_at) for r in rows}
    assert {("a", at(40)), ("b", at(90)), ("c", at(30))} <= got


def test_running_numbers_cross_buckets(spark):
    rows = [("k", i, i % 5) for i in range(100)] + [(None, i, 1) for i in range(7)]
    df = spark.createDataFrame(rows, "k string, n long, v long")
    bucket = F.floor(F.col("n") / 9)
    got = {(r.k, r.n): r.x for r in running_number(df, ["k"], ["n"], bucket, "x").collect()}
    assert got == {(k, n): n + 1 for k, n, _ in rows}
    down = running_total(df.where("k = 'k'"), ["k"], ["n"], bucket, F.col("v"), "x", descending=True).collect()
    assert {r.n: r.x for r in down} == {n: sum(i % 5 for i in range(n, 100)) for n in range(100)}
    following = next_value(df.where("n % 30 = 0 AND k = 'k'"), ["k"], "n", bucket, "x").collect()
    assert {r.n: r.x for r in following} == {0: 30, 30: 60, 60: 90, 90: None}


def test_tokens_sessions_and_logs(spark):
    tokens = spark.createDataFrame(
        [(1, 2, "token", "lo"), (1, 1, "token", "hel"), (1, 3, "citations", "[c]"), (1, 4, "done", ""), (2, 1, "error", "x")],
        "answer_id long, seq long, type string, text string",
    )
    rows = ev.assemble_tokens(tokens).orderBy("answer_id").collect()
    assert [(r.answer, r.citations, r.ended_with) for r in rows] == [("hello", "[c]", "done"), ("", None, "error")]
    events = spark.createDataFrame([("t", at(5)), ("t", at(50)), ("u", at(5))], "token_id string, ts timestamp")
    revoked = spark.createDataFrame([("t", at(0), 30), ("u", at(0), 0)], "token_id string, revoked_at timestamp, ttl_seconds int")
    assert {(r.token_id, r.ts) for r in ev.active_sessions(events, revoked).collect()} == {("t", at(50)), ("u", at(5))}
    log = 'event: a\ndata: {"x":1}\n\ndata: 2\n\nevent: b\n\nevent: c\ndata: [1,\ndata: 2]\n\nevent: d\ndata: 1'
    rows = ev.parse_event_log(spark.createDataFrame([(log,)], "log string")).orderBy("seq").collect()
    assert [(r.name, r.data) for r in rows] == [("a", '{"x":1}'), ("c", "[1,\n2]")]


def test_quality_scores(spark):
    results = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "x", 1)], "query_id long, chunk_id string, rank int")
    expected = spark.createDataFrame([(1, "b"), (1, "z"), (2, "y")], "query_id long, chunk_id string")
    rows = metrics.retrieval_metrics(results, expected, 2).orderBy("query_id").collect()
    assert [(r.recall, r.precision, r.reciprocal_rank) for r in rows] == [(0.5, 0.5, 0.5), (0.0, 0.0, 0.0)]
