"""Scoring, ranking and assessing control mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.functions.numeric import Viability, viability, viability_weight
from cartulary.operators.quantiles import of_counts
from cartulary.operators.stored import stored as written

#: Relationship types that call for action.
ACTIONABLE = ("EQUIVALENT", "SUPERSET_OF", "SUBSET_OF", "CONTRIBUTES_TO", "COMPLEMENTS", "PARTIAL")


def classified(inputs: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds source_type, source_level, target_type, target_level from ``classes`` (control_id, type, level).

    What has no class, or a blank one, is Unknown and Tactical. ``classes`` holds one row a control.
    """
    out = inputs
    for side in ("source", "target"):
        own = classes.select(
            F.col("control_id").alias(f"{side}_id"), F.col("type").alias(f"_{side}_type"), F.col("level").alias(f"_{side}_level")
        )
        out = out.join(own, f"{side}_id", "left")
        for part, default in (("type", "Unknown"), ("level", "Tactical")):
            filled = F.coalesce(F.nullif(F.col(f"_{side}_{part}"), F.lit("")), F.lit(default))
            out = out.withColumn(f"{side}_{part}", filled).drop(f"_{side}_{part}")
    return out


def ranked(inputs: DataFrame, classes: DataFrame, factors: Viability = Viability()) -> DataFrame:
    """Adds the classes, viability and viability_weight to (source_id, target_id, score, contribution, ...)."""
    rows = classified(inputs, classes)
    sides = lambda part: (F.col(f"source_{part}"), F.col(f"target_{part}"))
    return rows.withColumns(
        {
            "viability": viability(F.col("score"), sides("type"), sides("level"), factors),
            "viability_weight": viability_weight(F.col("score"), sides("type"), sides("level"), F.col("contribution"), factors),
        }
    )


def confident(rows: DataFrame, threshold: float, column: str = "confidence") -> DataFrame:
    """Rows at or above the threshold; a threshold of 0 or less keeps all."""
    return rows.where(F.col(column) >= threshold) if threshold > 0 else rows


def capped(rows: DataFrame, most: int, *order: Column) -> DataFrame:
    """At most ``most`` rows of each source: those of highest viability_weight, ties by ``order``. 0 or less keeps all.

    ``row_number`` under a filter lets Spark cut each group before the shuffle.
    """
    if most <= 0:
        return rows
    w = Window.partitionBy("source_id").orderBy(F.col("viability_weight").desc(), *(order or (F.col("target_id"),)))
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank")


def validated(inputs: DataFrame, most: int | None = None) -> DataFrame:
    """The inputs, with an error raised for the first that has an empty or over-long id (256 bytes), a score that is
    negative or not finite, or a confidence outside 0 to 1. ``most`` is an optional ceiling on their number."""
    if most is not None and inputs.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} inputs")
    ids_ok = F.lit(True)
    for c in ("source_id", "target_id"):
        ids_ok = ids_ok & F.coalesce(F.octet_length(c).between(1, 256), F.lit(False))
    score_ok = F.coalesce(~F.isnan("score") & (F.col("score") >= 0) & (F.col("score") < float("inf")), F.lit(False))
    confidence_ok = F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False))
    problem = F.when(~ids_ok, "bad id").when(~score_ok, "bad score").when(~confidence_ok, "bad confidence")
    return inputs.withColumn("_bad", problem).where(F.when(F.col("_bad").isNotNull(), F.raise_error(F.col("_bad")).cast("boolean")).otherwise(True)).drop("_bad")


def report(rows: DataFrame) -> DataFrame:
    """One row: counts, averages, the histogram of relationships, how many sources are covered, and the interquartile
    range of the scores (null without scores).

    The rows are read once: they are grouped by relationship, by source and by score at the same time, and what follows
    reads the groups, which are written down.
    """
    actionable = F.col("relationship").isin(*ACTIONABLE) & (F.col("viability_weight") > 0)
    measured = rows.select("relationship", "source_id", "score", "confidence", "viability_weight", "unanimous", actionable.alias("actionable"))
    sets = [[F.col("relationship")], [F.col("source_id")], [F.col("score")]]
    groups = written(
        measured.groupingSets(sets, "relationship", "source_id", "score").agg(
            F.grouping_id("relationship", "source_id", "score").alias("set"),
            F.count("*").alias("n"),
            F.count_if(F.col("viability_weight") > 0).alias("n_viable"),
            F.sum("confidence").alias("sum_confidence"),
            F.sum("viability_weight").alias("sum_viability"),
            F.count_if(~F.col("unanimous")).alias("n_contested"),
            F.max("actionable").alias("covered"),
        )
    )
    by_relationship, by_source, by_score = (groups.where(F.col("set") == bits) for bits in (0b011, 0b101, 0b110))
    totals = by_relationship.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("n_viable"), F.lit(0)).alias("viable"),
        F.coalesce(F.sum("sum_confidence") / F.sum("n"), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.sum("sum_viability") / F.sum("n"), F.lit(0.0)).alias("avg_viability"),
        F.coalesce(F.sum(F.when(F.col("relationship") == "NO_RELATIONSHIP", F.col("n"))), F.lit(0)).alias("no_relationship"),
        F.coalesce(F.sum("n_contested"), F.lit(0)).alias("contested"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("relationship", "n")))).alias("by_relationship"),
    )
    coverage = by_source.agg(F.count("*").alias("sources"), F.count_if("covered").alias("covered_sources"))
    quarters = of_counts(by_score.select(F.col("score").alias("value"), "n"), {"low": 0.25, "high": 0.75})
    return totals.crossJoin(coverage).crossJoin(quarters.select((F.col("high") - F.col("low")).alias("iqr")))  # one row each


def diagnostics(
    reported: DataFrame, iqr: tuple[float, float] = (5.0, 15.0), no_relationship: tuple[float, float] = (0.1, 0.9), contested: float = 0.3, coverage: float = 0.5
) -> DataFrame:
    """A row (name, level, value, message) for each diagnostic of a report; none for an empty one."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    spread = F.when(F.col("total") < 4, 0.0).otherwise(F.col("iqr"))
    none, split, cover = share("no_relationship", "total"), share("contested", "total"), share("covered_sources", "sources")
    percent = lambda text, x: F.format_string(text + " %.1f%%", x * 100)
    row = lambda name, level, value, message: F.struct(F.lit(name).alias("name"), level.alias("level"), value.alias("value"), message.alias("message"))
    rows = F.array(
        row(
            "iqr",
            F.when(F.col("total") < 4, "warn").when(spread >= iqr[1], "good").when(spread < iqr[0], "poor").otherwise("warn"),
            spread,
            F.format_string("interquartile range %.1f", spread),
        ),
        row(
            "no_relationship_rate",
            F.when(none > no_relationship[1], "poor").when(none < no_relationship[0], "warn").otherwise("good"),
            none,
            percent("without relationship", none),
        ),
        row("contested_rate", F.when(split > contested, "warn").otherwise("good"), split, percent("contested", split)),
        row("actionable_coverage", F.when(cover < coverage, "warn").otherwise("good"), cover, percent("sources covered", cover)),
    )
    return reported.where("total > 0").select(F.inline(rows))


def stored(votes: DataFrame, computed: DataFrame) -> DataFrame:
    """``votes`` with viability_weight taken from ``computed`` by (job_id, source_id, target_id).

    If any computed row has no vote to go to, nothing is stored: an error is raised.
    """
    keys = ["job_id", "source_id", "target_id"]
    if not computed.join(votes.select(*keys), keys, "left_anti").isEmpty():
        raise ValueError("computed rows without a stored pair; nothing is stored")
    new = computed.select(*keys, F.col("viability_weight").alias("_new"))
    old = F.col("viability_weight") if "viability_weight" in votes.columns else F.lit(None).cast("double")
    return votes.join(new, keys, "left").withColumn("viability_weight", F.coalesce("_new", old)).drop("_new")

