"""Analyzers that depend on each other: registration, order, and running them level by level."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.operators.stored import stored


@dataclass
class Analyzer:
    """run takes the outputs of what it depends on, by name, and gives its own, which has the columns of ``schema`` (a
    DDL string) if one is named."""

    name: str
    run: Callable[[Mapping[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()
    schema: str | None = None


class Incomplete(Exception):
    """Some tasks failed: carries the output of the others."""

    def __init__(self, output: DataFrame, failed_tasks: int):
        super().__init__(f"{failed_tasks} tasks failed")
        self.output, self.failed_tasks = output, failed_tasks


def staged(
    name: str, generate: Callable[[Mapping[str, DataFrame]], DataFrame], work: Callable[[DataFrame], DataFrame], aggregate: Callable[[DataFrame], DataFrame], needs: tuple[str, ...] = (), schema: str | None = None
) -> Analyzer:
    """An analyzer in three steps: tasks are generated, worked on (results have a column ``error``, null where the task
    is done), and what was done is aggregated. The results are written down between. If every task failed, the
    analyzer did; if some did, its output is marked as incomplete."""

    def run(inputs: Mapping[str, DataFrame]) -> DataFrame:
        results = stored(work(generate(inputs)))
        bad = F.coalesce("error", F.lit("")) != ""
        n, failed = results.agg(F.count("*"), F.count_if(bad)).first()
        if n and failed == n:
            raise RuntimeError(f"all {n} tasks failed")
        output = aggregate(results.where(~bad).drop("error"))
        if failed:
            raise Incomplete(output, failed)
        return output

    return Analyzer(name, run, needs, schema)


def checked(output: DataFrame, schema: str | None) -> DataFrame:
    """The output, if it has the columns of the schema, in any order and with nulls or without."""
    if schema is not None:
        kinds = lambda s: {f.name: f.dataType.simpleString() for f in s}
        want = kinds(T.StructType.fromDDL(schema))
        if kinds(output.schema) != want:
            raise ValueError(f"invalid output: {kinds(output.schema)} instead of {want}")
    return output


#: The built-in analyzers and what they depend on.
BUILT_IN = {"classify": (), "artifacts": (), "embedding": ("classify",), "relationship": ("embedding",), "requires": ("embedding",)}


def levels(needs: Mapping[str, tuple[str, ...]]) -> list[list[str]]:
    """Names in levels: each level needs only what is in earlier ones; by name within a level."""
    if missing := {d for ds in needs.values() for d in ds} - needs.keys():
        raise LookupError(f"missing: {sorted(missing)}")
    done: set[str] = set()
    out = []
    while len(done) < len(needs):
        ready = sorted(n for n, ds in needs.items() if n not in done and done.issuperset(ds))
        if not ready:
            raise ValueError(f"cycle among {sorted(needs.keys() - done)}")
        out.append(ready)
        done.update(ready)
    return out


def subset(needs: Mapping[str, tuple[str, ...]], *names: str) -> dict[str, tuple[str, ...]]:
    """The names and all they depend on."""
    wanted, work = set(), list(names)
    while work:
        n = work.pop()
        if n not in needs:
            raise LookupError(f"missing: {n}")
        if n not in wanted:
            wanted.add(n)
            work += needs[n]
    return {n: needs[n] for n in needs if n in wanted}


@dataclass
class Outcome:
    outputs: dict[str, DataFrame] = field(default_factory=dict)
    status: dict[str, str] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)
    #: Of an analyzer that went on without failed tasks, how many they were.
    failed_tasks: dict[str, int] = field(default_factory=dict)


class Registry:
    """Analyzers by name."""

    def __init__(self) -> None:
        self.analyzers: dict[str, Analyzer] = {}
        self.lock = threading.Lock()

    def register(self, analyzer: Analyzer) -> None:
        if analyzer.name in self.analyzers:
            raise ValueError(f"taken: {analyzer.name}")
        self.analyzers[analyzer.name] = analyzer

    def _start(self, spark: SparkSession, name: str, inputs: Mapping[str, DataFrame], out: Outcome) -> tuple[threading.Thread, str]:
        """Runs an analyzer in a thread of its own, whose Spark jobs are a group that can be cancelled."""
        group = f"analyzer-{name}-{uuid.uuid4().hex}"

        def run() -> None:
            spark.sparkContext.setJobGroup(group, f"analyzer {name}", interruptOnCancel=True)
            failed = 0
            try:
                try:
                    made = self.analyzers[name].run(inputs)
                except Incomplete as e:
                    made, failed = e.output, e.failed_tasks
                made = stored(checked(made, self.analyzers[name].schema))
            except Exception as e:  # an analyzer's failure is a result, not the end of the run
                self._end(out, name, "failed", error=sanitised(str(e)))
            else:
                self._end(out, name, "completed", made, failed)

        thread = threading.Thread(target=inheritable_thread_target(spark)(run), name=group, daemon=True)
        thread.start()
        return thread, group

    def _end(self, out: Outcome, name: str, status: str, output: DataFrame | None = None, failed: int = 0, error: str | None = None) -> None:
        """The first end of an analyzer counts: what comes after its time was over is passed over."""
        with self.lock:
            if name in out.status:
                return
            out.status[name] = status
            if output is not None:
                out.outputs[name] = output
            if failed:
                out.failed_tasks[name] = failed
            if error is not None:
                out.errors[name] = error

    def execute(self, *names: str, completed: Mapping[str, DataFrame] | None = None, timeout_s: float | None = None) -> Outcome:
        """Runs the named analyzers and what they need, level by level; those of a level at the same time, each to its
        end whatever becomes of the others. Their outputs are written down as a part of the run.

        What is completed already is not run again, and what depends on a failure is skipped. An analyzer that takes
        longer than ``timeout_s`` has failed: its Spark jobs are cancelled.
        """
        spark = SparkSession.active()
        needs = subset({n: a.needs for n, a in self.analyzers.items()}, *(names or self.analyzers))
        out = Outcome(outputs=dict(completed or {}), status=dict.fromkeys(completed or {}, "completed"))
        for level in levels(needs):
            running = []
            for name in level:
                if name in out.outputs:
                    continue
                if any(out.status.get(d) != "completed" for d in needs[name]):
                    out.status[name] = "skipped"
                    continue
                running.append((name, *self._start(spark, name, {d: out.outputs[d] for d in needs[name]}, out)))
            end = None if timeout_s is None else time.monotonic() + timeout_s
            for name, thread, group in running:
                thread.join(None if end is None else max(0.0, end - time.monotonic()))
                if thread.is_alive():
                    self._end(out, name, "failed", error="timeout")
                    spark.sparkContext.cancelJobGroup(group)
        return out


def sanitised(message: str) -> str:
    """What may be told about an error: a category, never its text."""
    low = message.lower()
    if "timeout" in low or "timed out" in low or "deadline" in low:
        return "timeout"
    return "invalid" if "invalid" in low or "parse" in low else "failed"
