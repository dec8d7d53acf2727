"""The store of edges: what is stopped half way and run again leaves each edge once."""

import re
from datetime import datetime

import pytest

from cartulary.streaming import graph_sink
from cartulary.streaming.graph_sink import EdgeStore, sink

RESULT = "tenant_id string, job_id string, analyzer string, source_id string, target_id string, relationship string, confidence double, analyzed_at timestamp"
DAY = datetime(2025, 1, 1)


@pytest.fixture
def results(spark):
    rows = [(t, j, "relationship", f"s{k}", f"t{k}", "PARTIAL", 0.5, DAY) for t in ("7", "acme") for j in ("j1", "j2") for k in range(20)]
    return spark.createDataFrame(rows, RESULT)


def _messages(spark, *stages):
    rows = [(f"app.pipeline.{t}.{j}.stage.completed", f'{{"analyzer": "relationship", "job_id": "{j}"}}') for t, j in stages]
    return spark.createDataFrame([*rows, ("app.x", "{}"), ("app.pipeline.a.b.stage.completed", "no json")], "subject string, data string")


def _ids(store):
    return sorted((r.tenant_id, r.id) for r in store.edges().collect())


def test_a_batch_is_taken_once(spark, results, tmp_path):
    store = EdgeStore(spark, str(tmp_path / "s"))
    assert store.edges().count() == 0 == store.log().count()
    assert store.take(_messages(spark, ("acme", "j1")), results, "q", 0)
    first = _ids(store)
    assert len(first) == 20 and {t for t, _ in first} == {"acme"}
    assert not store.take(_messages(spark, ("acme", "j2")), results, "q", 0) and _ids(store) == first  # the log has it
    assert store.take(_messages(spark, ("acme", "j1"), ("7", "j1")), results, "q", 1)  # told again: only what is new
    assert len(_ids(store)) == 40 == len(set(_ids(store))) and [(r.batch, r.n) for r in store.log().orderBy("batch").collect()] == [("q-0", 20), ("q-1", 20)]
    assert store.take(_messages(spark), results, "q", 2) and len(_ids(store)) == 40  # nothing ended
    assert {r.tenant_id for r in store.edges(["7"]).collect()} == {"7"}
    assert re.search(r"PartitionFilters: \[[^\]]*tenant_id", store.edges(["7"])._jdf.queryExecution().toString())
    with pytest.raises(ValueError):
        store.append(store.edges(), "../x", 0)


def test_what_is_stopped_half_way_is_not_seen_and_replaced(spark, results, tmp_path, monkeypatch):
    store = EdgeStore(spark, str(tmp_path / "s"))
    store.take(_messages(spark, ("acme", "j1")), results, "q", 0)
    before, whole = _ids(store), _messages(spark, ("acme", "j1"), ("acme", "j2"), ("7", "j1"))

    class Stopped(Exception):
        pass

    def stop(*_):
        raise Stopped

    with monkeypatch.context() as m:  # edges are written, the log is not
        m.setattr(graph_sink.Observation, "get", property(stop))
        with pytest.raises(Stopped):
            store.take(whole, results, "q", 1)
    assert spark.read.parquet(str(tmp_path / "s/edges")).count() == 60 and _ids(store) == before
    assert store.take(whole, results, "q", 1)
    assert len(_ids(store)) == 60 == len(set(_ids(store))) == spark.read.parquet(str(tmp_path / "s/edges")).count()


def test_stream_into_the_store(spark, results, tmp_path):
    for k, stages in enumerate([[("acme", "j1")], [("acme", "j1"), ("7", "j2")]]):
        _messages(spark, *stages).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("subject string, data string").parquet(str(tmp_path / "in"))
        query = stream.writeStream.foreachBatch(sink(results, str(tmp_path / "s"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        assert len(_ids(EdgeStore(spark, str(tmp_path / "s")))) == 20 * (k + 1)
