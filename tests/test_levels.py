"""Analyzers of a level run at the same time; steps, schemas, failed tasks and timeouts."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from cartulary.operators import dag
from cartulary.operators.dag import Analyzer, Incomplete, Registry, staged


def _slow(spark, seconds, rows=4):
    def wait(batches):
        for b in batches:
            time.sleep(seconds)
            yield b

    return spark.range(rows).repartition(1).mapInPandas(wait, "id long")


def test_a_level_runs_at_the_same_time(spark):
    met, r = threading.Barrier(2, timeout=60), Registry()

    def meets(name):
        def run(_):
            made = _slow(spark, 1).agg(F.count("*").alias("n")).first()[0]  # a job of this thread
            met.wait()  # only if the other is here too
            return spark.createDataFrame([(name, made)], "name string, n long")

        return run

    r.register(Analyzer("a", meets("a")))
    r.register(Analyzer("b", meets("b")))
    r.register(Analyzer("bad", lambda _: spark.range(3).select(F.raise_error(F.lit("invalid row")).cast("string").alias("x"))))
    r.register(Analyzer("after", lambda x: x["a"].unionByName(x["b"]), ("a", "b")))
    r.register(Analyzer("after bad", lambda x: x["bad"], ("bad",)))
    out = r.execute()
    assert out.status == {"a": "completed", "b": "completed", "bad": "failed", "after": "completed", "after bad": "skipped"}
    assert out.errors == {"bad": "invalid"} and sorted(map(tuple, out.outputs["after"].collect())) == [("a", 4), ("b", 4)]


def test_timeout_cancels_the_jobs(spark):
    r = Registry()
    r.register(Analyzer("slow", lambda _: _slow(spark, 45)))
    r.register(Analyzer("quick", lambda _: spark.range(2)))
    r.register(Analyzer("behind", lambda x: x["slow"], ("slow",)))
    began = time.time()
    out = r.execute(timeout_s=8)
    assert time.time() - began < 30 and out.status == {"slow": "failed", "quick": "completed", "behind": "skipped"} and out.errors == {"slow": "timeout"}
    end = time.time() + 20
    while (left := [t for t in threading.enumerate() if t.name.startswith("analyzer-slow")]) and time.time() < end:
        time.sleep(0.2)
    assert not left and out.status["slow"] == "failed"  # its end after that changes nothing


def test_steps_and_failed_tasks(spark):
    def analyzer(name, bad, schema="total long"):
        work = lambda tasks: tasks.withColumn("error", F.when(F.expr(bad), "boom"))
        return staged(name, lambda x: x["in"].select("id"), work, lambda good: good.agg(F.sum("id").alias("total")), ("in",), schema)

    r = Registry()
    for a in (analyzer("whole", "false"), analyzer("partly", "id % 2 = 0"), analyzer("none", "true"), analyzer("other columns", "false", "total string")):
        r.register(a)
    r.register(Analyzer("in", lambda _: spark.range(10)))
    r.register(Analyzer("next", lambda x: x["partly"], ("partly",)))
    out = r.execute("whole", "next", "none", "other columns")
    assert out.status == {"in": "completed", "whole": "completed", "partly": "completed", "none": "failed", "other columns": "failed", "next": "completed"}
    assert out.failed_tasks == {"partly": 5} and out.errors == {"none": "failed", "other columns": "invalid"}
    assert out.outputs["whole"].first()[0] == 45 and out.outputs["next"].first()[0] == 25
    empty = Registry()
    empty.register(Analyzer("in", lambda _: spark.range(0)))
    empty.register(analyzer("whole", "true"))
    assert empty.execute().status["whole"] == "completed"  # no task, none failed
    with pytest.raises(ValueError):
        dag.checked(spark.range(1), "id string")
    assert Incomplete(None, 3).failed_tasks == 3
