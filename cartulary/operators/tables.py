"""Reading and changing the tables: tenants, pages, upserts and guards. A change gives the new frame; who calls writes
it to a new path and swaps, as files have no update in place."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TENANT = re.compile(r"[a-z][a-z0-9-]{1,62}[a-z0-9]")


def scoped(df: DataFrame, tenant: str, user: str | None = None) -> DataFrame:
    """The rows of one tenant; where rows have a user, only that user's and those without one."""
    if not tenant or not TENANT.fullmatch(tenant):
        raise PermissionError(f"no valid tenant: {tenant!r}")
    own = df.where(F.col("tenant_id") == tenant)
    if "user_id" in df.columns and user is not None:
        own = own.where(F.col("user_id").isNull() | (F.col("user_id") == user))
    return own


OPERATORS = {
    "eq": lambda c, v: c == v,
    "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
    "contains": lambda c, v: F.contains(c, F.lit(v)),
    "in": lambda c, v: c.isin(*v),
}


def filtered(df: DataFrame, filters: list[tuple[str, str, object]] = ()) -> DataFrame:
    """Rows that meet every (column, operator, value); a value of None, or an empty list, is no filter."""
    for column, operator, value in filters:
        if operator not in OPERATORS:
            raise ValueError(f"unknown operator {operator}")
        if value is None or value == []:
            continue
        df = df.where(OPERATORS[operator](F.col(column), value))
    return df


def lookup(df: DataFrame, **key) -> DataFrame:
    """The one row with these values, scoped as ``df`` is; LookupError without one. Only the key's row is looked for: the
    filter goes to the reader."""
    own = df
    for column, value in key.items():
        own = own.where(F.col(column) == F.lit(value))
    own = own.limit(1)
    if own.isEmpty():
        raise LookupError(f"not found: {', '.join(f'{k}={v}' for k, v in key.items())}")
    return own


def page(df: DataFrame, order: list[Column | str], limit: int = 0, offset: int = 0) -> DataFrame:
    """One page: 50 rows unless asked, 1000 at most. A deep offset is a sort of what comes before it."""
    limit = 50 if limit <= 0 else min(limit, 1000)
    return df.orderBy(*order).offset(max(offset, 0)).limit(limit)


def paged(df: DataFrame, order: list[Column | str], limit: int = 0, offset: int = 0) -> tuple[DataFrame, int, int | None]:
    """A page, the number of all rows, and the next page's offset; None on the last page."""
    limit, offset = 50 if limit <= 0 else min(limit, 1000), max(offset, 0)
    total = df.count()
    return page(df, order, limit, offset), total, offset + limit if offset + limit < total else None


def with_control_counts(catalogs: DataFrame, controls: DataFrame) -> DataFrame:
    """Catalogs with their number of controls and with defaults for what is not set."""
    counted = controls.groupBy("catalog_id").agg(F.count("*").alias("control_count"))
    out = catalogs.join(counted, "catalog_id", "left").withColumn("control_count", F.coalesce("control_count", F.lit(0)))
    for name, kind in catalogs.dtypes:
        if name in ("title", "version", "source_uri") or kind == "bigint" and name == "size":
            out = out.withColumn(name, F.coalesce(name, F.lit("" if kind == "string" else 0)))
    return out


def upserted(table: DataFrame, new: DataFrame, key: list[str], keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """``table`` with the rows of ``new`` in place of those of equal key; columns in ``keep`` stay as they were first.

    Of several new rows with one key the last by ``updated_at`` counts, where there is such a column.
    """
    if "updated_at" in new.columns:
        w = Window.partitionBy(*key).orderBy(F.col("updated_at").desc())
        new = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    else:
        new = new.dropDuplicates(key)
    held = [c for c in keep if c in table.columns]
    old = table.select(*key, *[F.col(c).alias(f"_{c}") for c in held])
    merged = new.join(old, key, "left")
    for c in held:
        merged = merged.withColumn(c, F.coalesce(f"_{c}", c) if c in new.columns else F.col(f"_{c}"))
    return table.join(new.select(*key), key, "left_anti").unionByName(merged.select(table.columns))


def deleted(table: DataFrame, condition: Column, must_exist: bool = False) -> DataFrame:
    """``table`` without the rows that meet the condition; unknown is not met."""
    hit = F.coalesce(condition, F.lit(False))
    if must_exist and table.where(hit).isEmpty():
        raise LookupError("nothing to delete")
    return table.where(~hit)


def guarded(changed: DataFrame, jobs: DataFrame, key: str = "job_id") -> DataFrame:
    """Rows that may change: an error if any belongs to a completed job."""
    if not changed.join(jobs.where(F.col("status") == "completed").select(key), key, "left_semi").isEmpty():
        raise PermissionError("a completed job cannot change")
    return changed


def write_once(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Appends; a key that is there already is an error."""
    if not new.join(table.select(*key), key, "left_semi").isEmpty():
        raise PermissionError("written once")
    return table.unionByName(new.select(table.columns))


def stamped(jobs: DataFrame, job: str, status: str, moment: Column) -> DataFrame:
    """A job's new status: running sets started_at, completed and failed set completed_at."""
    hit = F.col("job_id") == job
    out = jobs.withColumn("status", F.when(hit, F.lit(status)).otherwise(F.col("status")))
    column = {"running": "started_at", "completed": "completed_at", "failed": "completed_at"}.get(status)
    return out.withColumn(column, F.when(hit, moment).otherwise(F.col(column))) if column else out


def reset_from(stages: DataFrame, job: str, stage: str, order: list[str]) -> DataFrame:
    """The stage and all after it in ``order`` are pending again, without times, with one more retry."""
    later = order[order.index(stage) :]
    hit = (F.col("job_id") == job) & F.col("stage").isin(*later)
    out = stages.withColumn("status", F.when(hit, "pending").otherwise(F.col("status")))
    for c in ("started_at", "completed_at"):
        out = out.withColumn(c, F.when(hit, F.lit(None)).otherwise(F.col(c)))
    return out.withColumn("retry_count", F.col("retry_count") + F.when(hit, 1).otherwise(0))


def retried(stages: DataFrame, job: str, order: list[str]) -> DataFrame:
    """Resets a job from its first failed stage."""
    failed = {r["stage"] for r in stages.where((F.col("job_id") == job) & (F.col("status") == "failed")).select("stage").collect()}
    first = next((s for s in order if s in failed), None)
    if first is None:
        raise ValueError("no failed stage")
    return reset_from(stages, job, first, order)


def retried_as_new(jobs: DataFrame, stages: DataFrame, job: str, new: str, order: list[str], moment: Column) -> tuple[DataFrame, DataFrame]:
    """(jobs, stages) with a copy of a failed job under a new id: what completed before its first failed stage stays
    completed, the failed stage and all after it are pending, and the old job is left as it is."""
    if new in {r["job_id"] for r in jobs.where(F.col("job_id").isin(job, new)).select("job_id").collect() if r["job_id"] == new}:
        raise ValueError(f"taken: {new}")
    own = jobs.where((F.col("job_id") == job) & (F.col("status") == "failed"))
    if own.isEmpty():
        raise LookupError(f"no failed job {job}")
    fresh = own.withColumn("job_id", F.lit(new)).withColumn("status", F.lit("pending"))
    for name, value in (("created_at", moment), ("started_at", F.lit(None)), ("completed_at", F.lit(None))):
        if name in jobs.columns:
            fresh = fresh.withColumn(name, value.cast(jobs.schema[name].dataType))
    copied = retried(stages.where(F.col("job_id") == job), job, order).withColumn("job_id", F.lit(new)).withColumn("retry_count", F.lit(0).cast(stages.schema["retry_count"].dataType))
    return jobs.unionByName(fresh.select(jobs.columns)), stages.unionByName(copied.select(stages.columns))


def resumable(jobs: DataFrame) -> DataFrame:
    """All running jobs, of every tenant, oldest first."""
    return jobs.where(F.col("status") == "running").orderBy("created_at", "job_id")


def duplicates(items: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """(id, problem) of ids that occur twice and of items that are their own parent."""
    twice = items.groupBy(key).count().where("count > 1").select(F.col(key).alias("id"), F.lit("duplicate").alias("problem"))
    own = items.where(F.col(key) == F.col(parent)).select(F.col(key).alias("id"), F.lit("own parent").alias("problem"))
    return twice.union(own)


def tally(results: DataFrame) -> DataFrame:
    """How many task results (analyzer, error, result, skipped) were processed, skipped or wrong; an analyzer fails only
    if all its tasks do."""
    bad = F.col("error").isNotNull() | F.col("result").isNull()
    skip = F.col("skipped") == "true"
    counted = results.groupBy("analyzer").agg(
        F.count_if(~bad & ~F.coalesce(skip, F.lit(False))).alias("processed"),
        F.count_if(~bad & F.coalesce(skip, F.lit(False))).alias("skipped"),
        F.count_if(bad).alias("errors"),
    )
    n = F.col("processed") + F.col("skipped")
    return counted.withColumns({"incomplete": F.col("errors") > 0, "failed": (n == 0) & (F.col("errors") > 0)})


def manifest(artifacts: DataFrame) -> DataFrame:
    """One row: digest and uri of every artifact, a line each, in order of uri; no row for none."""
    line = F.concat_ws("  ", "digest", "uri")
    lines = artifacts.agg(F.transform(F.sort_array(F.collect_list(F.struct("uri", line.alias("line")))), lambda x: x["line"]).alias("l"))
    return lines.where(F.size("l") > 0).select(F.concat(F.array_join("l", "\n"), F.lit("\n")).alias("manifest"))


def broken_links(steps: DataFrame, materials: DataFrame, products: DataFrame, order: list[str]) -> DataFrame:
    """Where a step's material and the step before it disagree on the digest of one uri: (step, uri, made, used).

    materials and products: step, uri, digest. Steps outside ``order`` come last, by name.
    """
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("step")), F.lit(0)), F.lit(len(order) + 1))
    w = Window.orderBy("_rank", "step")  # a layout has a handful of steps
    chain = steps.select("step", rank.alias("_rank")).withColumn("before", F.lag("step").over(w)).where("before is not null")
    used = materials.withColumnRenamed("digest", "used").join(chain.select("step", "before"), "step")
    made = products.select(F.col("step").alias("before"), "uri", F.col("digest").alias("made"))
    return used.join(made, ["before", "uri"]).where(F.col("made") != F.col("used")).select("step", "uri", "made", "used")
