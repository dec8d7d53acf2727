"""Messages with provenance: publishing, verifying, addressing, collecting and expiring."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The headers that every message carries.
HEADERS = ("job_id", "tenant_id", "component", "timestamp", "sha256")
#: Days that streams are kept; None is for ever.
RETENTION_DAYS = {"llm": 90, "events": 30, "decisions": None}


def subject(*tokens: str) -> str:
    """Tokens joined by stops; none is empty or has a stop, a star or a bracket."""
    for t in tokens:
        if not t or any(c in t for c in ".*> \t\n"):
            raise ValueError(f"bad token {t!r}")
    return ".".join(tokens)


def tenant_of(column: Column) -> Column:
    """The third token of a subject."""
    return F.get(F.split(column, r"\."), F.lit(2))


def matches(column: Column, pattern: str) -> Column:
    """Whether a subject fits a pattern: * is one token, > at the end the rest."""
    tokens = ["[^.]+" if t == "*" else ".+" if t == ">" else t.replace("-", r"\-") for t in pattern.split(".")]
    return column.rlike("^" + r"\.".join(tokens) + "$")


def published(messages: DataFrame, component: str, moment: Column | None = None) -> DataFrame:
    """(subject, data, headers) of messages (subject, data, tenant_id, job_id, headers): provenance wins over a header
    of the same name. A message without a tenant is an error. Works on streams and tables alike."""
    tenant = F.when(F.coalesce("tenant_id", F.lit("")) == "", F.raise_error(F.lit("a message needs a tenant")).cast("string")).otherwise(F.col("tenant_id"))
    own = F.create_map(
        F.lit("job_id"), F.coalesce("job_id", F.lit("")), F.lit("tenant_id"), tenant, F.lit("component"), F.lit(component),
        F.lit("timestamp"), (moment if moment is not None else F.current_timestamp()).cast("string"), F.lit("sha256"), F.sha2(F.col("data").cast("binary"), 256),
    )
    other = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*HEADERS))
    return messages.select("subject", "data", F.map_concat(other, own).alias("headers"))


def is_verified(data: Column, headers: Column) -> Column:
    """All headers are there and the hash is that of the data; anything else fails."""
    every = F.lit(True)
    for h in HEADERS:
        every = every & F.coalesce(headers[h].isNotNull(), F.lit(False))
    return every & F.coalesce(headers["sha256"] == F.sha2(data.cast("binary"), 256), F.lit(False))


def verified(messages: DataFrame) -> DataFrame:
    return messages.where(is_verified(F.col("data"), F.col("headers")))


def rejected(messages: DataFrame) -> DataFrame:
    return messages.where(~is_verified(F.col("data"), F.col("headers")))


def retained(messages: DataFrame, now: Column, days: dict[str, int | None] = RETENTION_DAYS, column: str = "ts") -> DataFrame:
    """Rows (stream, ``column``) that their stream still keeps; unknown streams keep all."""
    kept = F.lit(False)
    for stream, n in days.items():
        young = F.lit(True) if n is None else F.col(column) >= now - F.expr(f"interval {n} days")
        kept = kept | ((F.col("stream") == stream) & young)
    return messages.where(kept | ~F.col("stream").isin(*days))


def tasks(pairs: DataFrame, models: list[str], samples: int) -> DataFrame:
    """A task for each pair (job_id, source_id, target_id), model and sample."""
    each = pairs.withColumn("model", F.explode(F.array(*map(F.lit, models)))).withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    return each.withColumn("task_id", F.concat_ws(":", "job_id", "source_id", "target_id", "model", "sample"))


def collected(expected: DataFrame, results: DataFrame, most_retries: int = 3) -> DataFrame:
    """The batch form: a row for each expected task (job_id, task_id), with its first good result or its state.

    Unknown ids are ignored, further results of a task too. done has a good result before too many errors; failed had
    more errors than retries; else the task is pending.
    """
    # results: job_id, task_id, seq, payload, error
    good = F.coalesce("error", F.lit("")) == ""
    first = F.min(F.when(good, F.col("seq"))).over(Window.partitionBy("job_id", "task_id"))
    summed = results.withColumn("_first", first).groupBy("job_id", "task_id").agg(
        F.min_by(F.when(good, F.col("payload")), F.when(good, F.col("seq"))).alias("payload"), F.count_if(~good).alias("errors"), F.count_if(good).alias("good"),
        F.count_if(~good & (F.col("_first").isNull() | (F.col("seq") < F.col("_first")))).alias("before"),
    )
    state = F.when(F.col("before") > most_retries, "failed").when(F.col("good") > 0, "done").otherwise("pending")
    return expected.join(summed, ["job_id", "task_id"], "left").select(
        "job_id", "task_id", F.coalesce(state, F.lit("pending")).alias("state"), F.coalesce("errors", F.lit(0)).alias("errors"), F.when(state == "done", F.col("payload")).alias("payload")
    )


OUTCOME = "job_id string, event string, task_id string, payload string, attempt int, expected long, finished long"
#: What ends a task.
ENDS = ("result", "failed", "timeout")


def backoff_ms(task_id: str, errors: int, base_ms: int) -> int:
    """How long a task waits after its error of this number, from 1: twice as long each time, a quarter more or less; the
    same for the same task and error, so a batch run again waits as long."""
    jitter = 0.75 + 0.5 * (zlib.crc32(f"{task_id}:{errors}".encode()) % 1000) / 1000
    return int(max(base_ms, 0) * 2 ** (errors - 1) * jitter)


class Collector(StatefulProcessor):
    """The stateful form, keyed by job and shard: rows (job_id, shard, kind, task_id, payload, error), kind expect or
    result.

    A shard holds a map from bucket to its tasks: errors, when a task is to be sent out again (0: it is out) and when it
    is given up. A batch reads and writes only the buckets that it has rows of, each once. An error asks for a retry
    when its backoff is over, until there were too many; after ``timeout_ms`` a task is given up. A task that ended stays
    in the map, so that what comes for it later is ignored, until its time is over or ``ttl_ms`` have passed.
    """

    def __init__(self, most_retries: int = 3, timeout_ms: int = 300_000, base_ms: int = 1000, ttl_ms: int | None = None, grid_ms: int = 1000, buckets: int = 64):
        self.most_retries, self.timeout_ms, self.base_ms, self.ttl_ms, self.grid_ms, self.buckets = most_retries, timeout_ms, base_ms, ttl_ms, grid_ms, buckets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.map = handle.getMapState("tasks", "bucket int", "tasks array<struct<task_id:string,errors:int,due:long,deadline:long,ended:boolean>>", self.ttl_ms)

    def _rows(self, key: tuple, events: list[tuple], expected: int) -> pd.DataFrame:
        """The events, then what the shard's counts grow by."""
        finished = sum(e[0] in ENDS for e in events)
        rows = [(key[0], *e, 0, 0) for e in events] + ([(key[0], "progress", None, None, 0, expected, finished)] if expected or finished else [])
        return pd.DataFrame(rows, columns=["job_id", "event", "task_id", "payload", "attempt", "expected", "finished"])

    def _put(self, bucket: int, tasks: dict[str, tuple]) -> None:
        if tasks:
            self.map.updateValue((bucket,), ([(t, *state) for t, state in tasks.items()],))
        else:
            self.map.removeKey((bucket,))

    def _step(self, r, tasks: dict[str, tuple], now: int, events: list[tuple], wakes: set[int]) -> int:
        """What one row does to the tasks of its bucket; 1 if it is a new task."""
        state = tasks.get(r.task_id)
        if r.kind == "expect":
            if state is None:
                tasks[r.task_id] = (0, 0, now + self.timeout_ms, False)
                wakes.add(now + self.timeout_ms)
            return int(state is None)
        if state is None or state[3]:
            return 0
        errors, _, deadline, _ = state
        if not isinstance(r.error, str) or not r.error:
            events.append(("result", r.task_id, r.payload, errors))
            tasks[r.task_id] = (errors, 0, deadline, True)
        elif errors >= self.most_retries:
            events.append(("failed", r.task_id, None, errors + 1))
            tasks[r.task_id] = (errors + 1, 0, deadline, True)
        else:
            due = now + backoff_ms(r.task_id, errors + 1, self.base_ms)
            wakes.add(due)
            tasks[r.task_id] = (errors + 1, due, deadline, False)
        return 0

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, events, expected, wakes = timerValues.getCurrentProcessingTimeInMs(), [], 0, set()
        batch = pd.concat(list(rows)).dropna(subset=["task_id"])
        batch["bucket"] = [zlib.crc32(t.encode()) % self.buckets for t in batch["task_id"]]
        for bucket, own in batch.groupby("bucket"):
            held = self.map.getValue((int(bucket),))
            tasks = {t[0]: tuple(t[1:]) for t in held[0]} if held else {}
            for r in own.sort_values(["kind", "seq"], kind="stable").itertuples():  # what is expected comes first
                expected += self._step(r, tasks, now, events, wakes)
            self._put(int(bucket), tasks)
        for moment in {-(-w // self.grid_ms) * self.grid_ms for w in wakes}:  # on a grid, so that tasks share timers
            self.handle.registerTimer(moment)
        yield self._rows(key, events, expected)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, events = expiredTimerInfo.getExpiryTimeInMs(), []
        for (bucket,), (held,) in list(self.map.iterator()):
            left = {}
            for task, errors, due, deadline, ended in held:
                if deadline > now:
                    again = not ended and 0 < due <= now
                    left[task] = (errors, 0 if again else due, deadline, ended)
                    if again:
                        events.append(("retry", task, None, errors))
                elif not ended:
                    events.append(("timeout", task, None, errors))
            if left != {t[0]: tuple(t[1:]) for t in held}:
                self._put(bucket, left)
        yield self._rows(key, events, 0)

    def close(self) -> None:
        pass


def collect_stream(messages: DataFrame, collector: Collector | None = None, shards: int = 64) -> DataFrame:
    """The collector over a stream (job_id, kind, task_id, seq, payload, error): events (job_id, event, task_id, payload,
    attempt) result, retry, failed and timeout, and rows of progress, which count (expected, finished).

    A job's tasks are dealt over ``shards`` by their ids, so that a large job is no single group.
    """
    shard = F.pmod(F.xxhash64("task_id"), F.lit(shards)).cast("int").alias("shard")
    dealt = messages.select("job_id", shard, "kind", "task_id", "seq", "payload", "error")
    return dealt.groupBy("job_id", "shard").transformWithStateInPandas(collector or Collector(), OUTCOME, "Append", "ProcessingTime")


def job_progress(events: DataFrame) -> DataFrame:
    """(job_id, expected, finished, done) from events of ``collect_stream``, over a table or a stream of them: a job is
    done when as many tasks ended as were expected. Counts are added up before they are shuffled."""
    told = events.where("event = 'progress'").groupBy("job_id").agg(F.sum("expected").alias("expected"), F.sum("finished").alias("finished"))
    return told.withColumn("done", (F.col("expected") > 0) & (F.col("finished") >= F.col("expected")))
