"""The collector and verification over streams."""

import time

import pytest
from pyspark.sql import functions as F

from cartulary.streaming import bus
from cartulary.streaming.uploads import Uploads, uploads


def _batches(stream, tmp_path):
    """What a stream gives for the files that are there now: until a batch finds no more. (With timers, a query that
    takes what is available would go on for ever.)"""
    got = []
    query = stream.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start()
    end = time.time() + 120
    while time.time() < end and query.isActive:
        seen = [p["numInputRows"] for p in query.recentProgress]
        if any(seen) and not seen[-1]:
            break
        time.sleep(0.1)
    query.stop()
    assert query.exception() is None
    return got


def test_verified_stream(spark, tmp_path):
    m = spark.createDataFrame([("a.b.t", "data", "t", "j", {"x": "1"})], "subject string, data string, tenant_id string, job_id string, headers map<string,string>")
    m.write.parquet(str(tmp_path / "in"))
    stream = bus.verified(bus.published(spark.readStream.schema(m.schema).parquet(str(tmp_path / "in")), "me"))
    got = []
    query = stream.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120) and len(got) == 1


SCHEMA = "job_id string, kind string, task_id string, seq int, payload string, error string"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_collector(spark, tmp_path, rocks):
    rows = [("j", "expect", "1", 0, None, None), ("j", "expect", "2", 0, None, None), ("j", "result", "1", 1, "x", None), ("j", "result", "1", 2, "again", None), ("j", "result", "9", 1, "unknown", None), ("j", "result", "2", 1, None, "boom")]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = bus.collect_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), bus.Collector(1, base_ms=0, grid_ms=1))
    got = _batches(out, tmp_path)
    spark.createDataFrame([("j", "result", "2", 2, "y", None), ("j", "expect", "1", 0, None, None), ("j", "result", "1", 3, "late", None)], SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
    got += _batches(out, tmp_path)
    events = {(r.event, r.task_id, r.payload, r.attempt) for r in got if r.event not in ("progress", "retry")}
    assert events == {("result", "1", "x", 0), ("result", "2", "y", 1)} and len([r for r in got if r.event == "result"]) == 2
    progress = bus.job_progress(spark.createDataFrame(got, bus.OUTCOME)).first()
    assert (progress.expected, progress.finished, progress.done) == (2, 2, True)


def test_backoff_and_timeout(spark, tmp_path, rocks):
    """One task answers after a retry, one fails for good, one never answers: seen by a query that goes on running."""
    rows = [("j", "expect", t, 0, None, None) for t in "abc"] + [("j", "result", t, 1, None, "boom") for t in "ab"]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = bus.collect_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), bus.Collector(1, timeout_ms=20_000, base_ms=1500, grid_ms=100), 2)
    got = []
    query = out.writeStream.foreachBatch(lambda df, _: got.extend((time.time(), *r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    began = time.time()

    def wait(event, n):
        while len([r for r in got if r[2] == event]) < n and time.time() < began + 90 and query.isActive:
            time.sleep(0.1)

    wait("retry", 2)
    assert sorted((r[3], r[5]) for r in got if r[2] == "retry") == [("a", 1), ("b", 1)]
    spark.createDataFrame([("j", "result", "a", 2, "fine", None), ("j", "result", "b", 2, None, "boom")], SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
    wait("timeout", 1)
    query.stop()
    ends = sorted((r[2], r[3], r[4]) for r in got if r[2] in bus.ENDS)
    assert ends == [("failed", "b", None), ("result", "a", "fine"), ("timeout", "c", None)]
    progress = bus.job_progress(spark.createDataFrame([r[1:] for r in got], bus.OUTCOME)).first()
    assert (progress.expected, progress.finished, progress.done) == (3, 3, True)
    assert 0.75 * 1500 <= bus.backoff_ms("a", 1, 1500) <= 1.25 * 1500 and bus.backoff_ms("a", 3, 1000) >= 3000 and bus.backoff_ms("a", 1, -5) == 0


def test_large_job_over_batches_is_as_the_batch_form(spark, tmp_path, rocks):
    n, retries = 100_000, 2
    ids = spark.range(n).select(F.lit("job").alias("job_id"), F.concat(F.lit("t"), "id").alias("task_id"), "id")
    results = ids.withColumn("seq", F.explode(F.sequence(F.lit(1), F.lit(4)))).where("id % 10 <> 9")
    results = results.select("job_id", "task_id", "seq", F.concat_ws("-", "task_id", "seq").alias("payload"), F.expr("CASE WHEN seq <= id % 5 THEN 'boom' END").alias("error"))
    expect = ids.select("job_id", F.lit("expect").alias("kind"), "task_id", F.lit(0).alias("seq"), F.lit(None).cast("string").alias("payload"), F.lit(None).cast("string").alias("error"))
    got = []
    expect.coalesce(2).write.parquet(str(tmp_path / "in"))
    for seq in range(1, 5):
        part = results.where(F.col("seq") == seq).withColumn("kind", F.lit("result")).select(expect.columns)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = bus.collect_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), bus.Collector(retries, timeout_ms=10**9, base_ms=10, ttl_ms=10**9), 16)
        got += _batches(out, tmp_path)
    events = spark.createDataFrame(got, bus.OUTCOME)
    ended = events.where(F.col("event").isin(*bus.ENDS)).select("task_id", F.expr("CASE event WHEN 'result' THEN 'done' ELSE event END").alias("state"), "payload")
    batch = bus.collected(ids.select("job_id", "task_id"), results, retries).where("state <> 'pending'").select("task_id", "state", "payload")
    assert ended.count() == batch.count() == n * 9 // 10
    assert ended.exceptAll(batch).count() == 0 and {r.state for r in batch.select("state").distinct().collect()} == {"done", "failed"}
    progress = bus.job_progress(events).first()
    assert (progress.expected, progress.finished, progress.done) == (n, n * 9 // 10, False)


def test_uploads(spark, tmp_path, rocks):
    kind = "upload_id string, seq long, kind string, metadata string, data binary"
    meta = lambda u: (u, 0, "metadata", f"about {u}", None)
    chunk = lambda u, seq, data: (u, seq, "chunk", None, data)
    end = lambda u, seq: (u, seq, "end", None, None)
    batches = [
        [meta("a"), chunk("a", 1, b"one "), meta("b"), chunk("c", 0, b"no metadata"), meta("big"), chunk("big", 1, b"x" * 60), meta("late"), chunk("gap", 2, b"3"), end("gap", 3)],
        [chunk("a", 2, b"two"), chunk("a", 1, b"one "), end("b", 1), ("twice", 1, "metadata", "m", None), chunk("big", 2, b"x" * 60), end("big", 3), chunk("c", 1, b"x")],
        [end("a", 3), chunk("a", 4, b"after the end"), meta("gap"), chunk("gap", 1, b"12"), end("none", 0), chunk("big", 4, b"x"), meta("odd"), ("odd", 1, "other", None, None)],
    ]
    got = []
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got += _batches(uploads(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), most_bytes=100), tmp_path)
    assert sorted((r.upload_id, r.status, r.reason, r.metadata, None if r.content is None else bytes(r.content)) for r in got) == [
        ("a", "done", None, "about a", b"one two"), ("b", "done", None, "about b", b""), ("big", "rejected", "upload exceeds maximum size of 100 bytes", None, None),
        ("c", "rejected", "first message must contain metadata", None, None), ("gap", "done", None, "about gap", b"123"), ("none", "rejected", "first message must contain metadata", None, None),
        ("odd", "rejected", "unknown message other", None, None), ("twice", "rejected", "metadata must appear exactly once as the first message", None, None),
    ]
    assert Uploads().most_bytes == 134_217_728
