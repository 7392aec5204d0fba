"""Streams in several micro-batches give the batch answer."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilwork.operators.logs import guest_quota
from veilwork.plans.analyze import analyze
from veilwork.session import fresh_dir
from veilwork.sources import appends
from veilwork.sources.appends import append_once, append_stream, drop_unpublished, published, read_appended
from veilwork.streaming.gateway import action_counts, analyze_stream, run_to_table, session_stream
from veilwork.streaming.quota import _number, guest_quota_stream
from veilwork.streaming.scores import attach_score_stream, decide_scored


def replay(spark, df, parts, order):
    """The rows as one file per part, read one file per micro-batch."""
    path = fresh_dir(spark, "replay")
    rows = df.orderBy(order).collect()
    step = -(-len(rows) // parts)
    for i in range(parts):
        part = spark.createDataFrame(rows[i * step:(i + 1) * step], df.schema).coalesce(1)
        part.write.mode("append").parquet(f"{path}/part={i}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")


def events(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    return df.select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 7).alias("user_id"))


def quota_key(rows):
    return sorted((r.event_id, r.message_no, r.status) for r in rows)


def test_quota_over_batches(spark):
    df = events(spark)
    df = df.withColumn("user_id", F.expr("CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 4 > 0 THEN user_id END"))  # a busy guest, and nobody
    got = run_to_table(guest_quota_stream(replay(spark, df, 6, "ts"), "user_id", "ts", "event_id"), "quota")
    want = guest_quota(df, "user_id", "ts", "event_id")
    assert quota_key(got.collect()) == quota_key(want.collect())
    assert sorted(map(str, got.select("event_id", "user_id", "ts").collect())) == sorted(map(str, df.select("event_id", "user_id", "ts").collect()))
    assert {r.status for r in want.collect()} == {"ok", "warn", "refused"}


def test_quota_goes_on_after_a_restart_and_touches_a_batchs_guests_only(spark):
    day = datetime.datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp, user_id long"
    folder, path, state = fresh_dir(spark, "in"), fresh_dir(spark, "out"), fresh_dir(spark, "state")
    batches = [[(i, day, i) for i in range(50)], [(100, day, 1), (101, None, 1), (102, day, 99)], [(200, day, 1)]]
    touched = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = guest_quota_stream(spark.readStream.schema(schema).parquet(folder), "user_id", "ts", "event_id")
        # A new query each time, from the state that the one before left.
        query = (stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(path))
        query.awaitTermination()
        touched.append(sum(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]))
    got = {r.event_id: r.message_no for r in spark.read.parquet(path).collect()}
    assert (got[1], got[101], got[100], got[102], got[200]) == (1, 2, 3, 1, 4) and len(got) == 54
    assert touched == [50, 2, 1]


def test_silent_guests_start_anew():
    class State:
        value, hasTimedOut, timer = None, False, None
        exists = property(lambda self: self.value is not None)
        get = property(lambda self: self.value)

        def update(self, value):
            self.value = value

        def setTimeoutDuration(self, ms):
            self.timer = ms

        def remove(self):
            self.value = None

    state, number = State(), _number(15, 60_000)
    pack = pd.DataFrame({"at": [np.array([2, 1])], "key": [np.array([7, 8])]})
    first = pd.concat(number((False, "1"), iter([pack]), state))
    assert first["key"].tolist() == [8, 7] and state.value == (2,) and state.timer == 60_000
    assert pd.concat(number((False, "1"), iter([pack, pack]), state))["message_no"].tolist() == [3, 4, 5, 6]
    state.hasTimedOut = True
    assert list(number((False, "1"), iter([]), state)) == [] and not state.exists


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


def test_scores_late_early_and_missing(spark):
    messages = [(i, at(10 * i)) for i in range(60)]
    delays = {1: 5, 2: -1, 3: 11, 4: -2, 6: 10, 7: 0, 30: 9, 40: 5, 45: 300}
    scores = sorted(((i, at(10 * i + d), i / 100) for i, d in delays.items()), key=lambda r: r[1])
    ends = [(-1, at(100_000))]
    left = spark.createDataFrame(messages + ends, "id long, at timestamp")
    right = spark.createDataFrame(scores + [(-2, at(100_000), 0.0)], "id long, scored timestamp, score double")
    joined = attach_score_stream(replay(spark, left, 7, "at"), replay(spark, right, 4, "scored"), "id", "at", "scored", "score", late="3 hours")
    done = run_to_table(decide_scored(joined, "score", 0.065), "scored").filter("id >= 0").collect()
    want = {i: i / 100 if -1 <= delays.get(i, 99) <= 10 else None for i in range(60)}
    assert len(done) == 60 and {r.id: r.score for r in done} == want
    assert {r.id: (r.scan_status, r.action) for r in done} == {
        i: ("failed", "block") if s is None else ("ok", "block" if s >= 0.065 else "allow") for i, s in want.items()}


def test_appends_count_once(spark, monkeypatch):
    path = fresh_dir(spark, "appended")
    schema = "id BIGINT, created_at TIMESTAMP, day DATE"
    assert read_appended(spark, path, schema).count() == 0
    rows = spark.createDataFrame([(i, at(i * 600)) for i in range(20)], "id BIGINT, created_at TIMESTAMP")
    assert append_once(rows, path, "a") and not append_once(rows, path, "a")

    def dies(*_):
        raise RuntimeError("lost before it was published")

    with monkeypatch.context() as m:
        m.setattr(appends, "_publish", dies)
        with pytest.raises(RuntimeError):
            append_once(rows, path, "b")
    assert read_appended(spark, path, schema).count() == 20 and set(published(spark, path)) == {"a"}
    assert append_once(rows.withColumn("id", F.col("id") + 100), path, "b")
    got = read_appended(spark, path, schema)
    assert sorted(r.id for r in got.collect()) == [*range(20), *range(100, 120)]
    assert got.filter("day = DATE '2024-01-01'").count() == 6
    assert drop_unpublished(spark, path) == 1 and got.count() == 40
    for name in ("", "a/b", "x@y", ".hidden"):
        with pytest.raises(ValueError):
            append_once(rows, path, name)


def test_a_repeated_micro_batch_counts_once(spark, monkeypatch):
    """The stream dies after a batch was published and before Spark noted it; the restart repeats the batch."""
    df = events(spark)
    path, state = fresh_dir(spark, "appended"), fresh_dir(spark, "appended-state")
    stream, done = replay(spark, df, 5, "ts"), []
    whole = appends.append_once

    def dies_once(rows, *args):
        whole(rows, *args)
        done.append(1)
        if len(done) == 3:
            raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(appends, "append_once", dies_once)
        with pytest.raises(Exception, match="lost"):
            append_stream(stream, path, state, "events")
    append_stream(stream, path, state, "events")
    got = read_appended(spark, path, "event_id BIGINT, ts TIMESTAMP, user_id BIGINT")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect())) and len(published(spark, path)) == 5


def test_gateway_over_batches(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = run_to_table(analyze_stream(replay(spark, df, 3, "doc_id")).select("doc_id", "action", "masked_output"), "gateway")
    assert sorted(got.collect()) == sorted(analyze(df).select("doc_id", "action", "masked_output").collect())


def test_closed_sessions_and_windows_come_once(spark):
    df = events(spark)
    closed = run_to_table(session_stream(replay(spark, df, 3, "ts"), "user_id", "ts"), "sessions")
    batch = df.groupBy("user_id", F.session_window("ts", "8 hours").alias("s")).count().select("user_id", "s.start", "s.end", "count")
    assert set(map(tuple, closed.collect())) <= set(map(tuple, batch.collect()))
    decided = replay(spark, df.withColumn("action", F.lit("allow")), 3, "ts")
    counts = run_to_table(action_counts(decided, "ts"), "counts").collect()
    hours = {r["h"]: r["count"] for r in df.groupBy(F.date_trunc("hour", "ts").alias("h")).count().collect()}
    assert counts and all(hours[r.window_start] == r.n for r in counts)
