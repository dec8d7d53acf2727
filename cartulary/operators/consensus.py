"""From the votes of a panel to consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartulary.functions.numeric import round_n
from cartulary.functions.parsers import ARTIFACT_TYPES, RELATIONSHIPS



def _rank(column: str, names: tuple[str, ...]) -> F.Column:
    return F.array_position(F.array(*map(F.lit, names)), F.col(column))


def plurality(votes: DataFrame) -> DataFrame:
    """A row a pair of ``votes`` (pair_id, vote_key, relationship, contribution, parse_status).

    Votes that failed to parse count for nothing but are listed. The most frequent relationship wins, ties by priority;
    confidence is its share of valid votes. If the winner is CONTRIBUTES_TO its voters also settle the contribution:
    INTEGRAL_TO unless EXAMPLE_OF has more. Counts are summed by pair and relationship first; the names of all votes go
    along, since they are a part of the result.
    """
    valid = F.col("relationship").isNotNull() & ~F.col("parse_status").isin("PARSE_FAIL", "PARSE_ERROR")
    shown = F.when(valid, F.col("relationship")).otherwise(F.coalesce(F.col("parse_status"), F.lit("PARSE_FAIL")))
    counted = votes.groupBy("pair_id", F.when(valid, F.col("relationship")).alias("relationship")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("contribution") == "INTEGRAL_TO").alias("integral"),
        F.count_if(F.col("contribution") == "EXAMPLE_OF").alias("example"),
        F.collect_list(F.struct("vote_key", shown.alias("name"))).alias("votes"),
    )
    real = F.col("relationship").isNotNull()
    order = F.struct("n", (-_rank("relationship", RELATIONSHIPS)).alias("p"))
    best = F.max_by(F.struct("relationship", "n", "integral", "example"), F.when(real, order))
    summed = counted.groupBy("pair_id").agg(
        best.alias("best"),
        F.sum(F.when(real, F.col("n")).otherwise(0)).alias("valid_vote_count"),
        F.sort_array(F.flatten(F.collect_list("votes"))).alias("votes"),
    )
    any_valid = F.col("valid_vote_count") > 0
    b = F.col("best")
    kind = F.when((b["integral"] > 0) & (b["integral"] >= b["example"]), "INTEGRAL_TO").when(b["example"] > 0, "EXAMPLE_OF").otherwise("")
    return summed.select(
        "pair_id",
        F.when(any_valid, b["relationship"]).otherwise("NO_RELATIONSHIP").alias("relationship"),
        F.when(any_valid & (b["relationship"] == "CONTRIBUTES_TO"), kind).otherwise("").alias("contribution"),
        F.when(any_valid, round_n(b["n"] / F.col("valid_vote_count"), 3)).otherwise(0.0).alias("confidence_fraction"),
        (any_valid & (b["n"] == F.col("valid_vote_count"))).alias("unanimous"),
        "valid_vote_count",
        F.transform("votes", lambda v: v["name"]).alias("all_votes"),
    )


def weighted_binary(votes: DataFrame, min_valid: int = 1, max_error_rate: float = 0.0) -> DataFrame:
    """A row a pair of ``votes`` (pair_id, decision, weight), with a status.

    A null decision is an error vote, a weight of 0 counts as 1. Yes needs strictly more weight than no. status is ok,
    insufficient (fewer valid votes than ``min_valid``) or errors (a share above ``max_error_rate``, if that is set).
    """
    weight = F.when(F.coalesce(F.col("weight"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight"))
    summed = votes.groupBy("pair_id").agg(
        F.coalesce(F.sum(F.when(F.col("decision"), weight)), F.lit(0.0)).alias("yes"),
        F.coalesce(F.sum(F.when(~F.col("decision"), weight)), F.lit(0.0)).alias("no"),
        F.count("decision").alias("valid"),
        F.count("*").alias("n"),
    )
    total = F.col("yes") + F.col("no")
    errors = (F.col("n") - F.col("valid")) / F.col("n")
    too_many = (errors > max_error_rate) if max_error_rate > 0 else F.lit(False)
    return summed.select(
        "pair_id",
        (F.col("yes") > F.col("no")).alias("decision"),
        F.when(total > 0, F.greatest("yes", "no") / total).otherwise(0.0).alias("confidence"),
        ((total > 0) & (F.least("yes", "no") == 0)).alias("unanimous"),
        "valid",
        F.when((F.col("valid") < min_valid) & (F.col("valid") > 0), "insufficient").when(too_many, "errors").otherwise("ok").alias("status"),
    )


def meets(confidence: F.Column, threshold: float = 0.5) -> F.Column:
    """At or above the threshold; one outside 0 to 1 counts as a half."""
    return confidence >= (threshold if 0 <= threshold <= 1 else 0.5)


def vote_aggregation(feedback: DataFrame) -> DataFrame:
    """Counts of people's votes (pair_id, vote) and the share that agrees; escalation if anyone asks for it."""
    n = lambda v: F.count_if(F.col("vote") == v)
    return feedback.groupBy("pair_id").agg(
        n("agree").alias("agree"), n("disagree").alias("disagree"), n("refine").alias("refine"), n("escalate").alias("escalate"),
        (n("agree") / F.count("*")).alias("agreement_score"), (n("escalate") > 0).alias("needs_escalation"),
    )


ARTIFACT = "name string, type string, frequency string, owner_role string, description string, properties map<string,string>"


#: White space of every script.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def artifact_consensus(votes: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Groups the artifacts that voters name for a control (control_id, vote_key, parse_status, artifacts).

    Votes in order of key, which tells a control's votes apart; an artifact joins the first group whose first member's
    normal name overlaps enough, else it opens one. A group's confidence is its voters over all of the control's votes,
    failed ones included.

    Groups are only ever added behind, so all artifacts of a control with the same words end where the first of them does:
    these are summed up first, and only the different sets of words of a control are gone through in order. An artifact
    without words is a group of its own.
    """
    named = votes.select("control_id", "vote_key", F.posexplode_outer(F.when(F.col("parse_status") == "OK", F.col("artifacts"))).alias("pos", "a"))
    fields = ("name", "type", "frequency", "owner_role", "description")
    at = F.struct("vote_key", "pos")
    own = named.select(
        "control_id", "vote_key", "pos", _words(F.col("a")["name"]).alias("words"), *[F.col("a")[f].alias(f) for f in fields],
        F.sort_array(F.map_entries(F.col("a")["properties"])).alias("properties"),
    )
    alone = (F.col("words") == "") if threshold <= 1 else F.lit(True)
    # A field's own place goes with it: the first filled one of a group need not be of the first artifact.
    first = {f: F.when(F.col(f) != "", F.struct("at", F.col(f).alias("value"))) for f in ("name", "frequency", "owner_role")}
    first["description"] = F.when(F.col("description") != "", F.struct(-F.octet_length("description"), "at", F.col("description").alias("value")))
    least = [F.min(f).alias(f) for f in first]
    like = own.withColumn("at", at).withColumns(first).groupBy("control_id", "words", F.when(alone, F.col("at")).alias("alone"), "type", "properties").agg(
        F.count_if(F.coalesce(F.col("pos"), F.lit(0)) == 0).alias("n_votes"), F.count("pos").alias("n"), *least,
        F.collect_set("vote_key").alias("voters"), F.min("at").alias("at"),
    )
    some = F.when(F.col("n") > 0, F.struct("at", "words", "type", "properties", "n", "name", "frequency", "owner_role", "description", "voters"))
    control = like.groupBy("control_id").agg(F.sum("n_votes").alias("n_votes"), F.sort_array(F.collect_list(some)).alias("like"))
    homes = _homes(F.transform("like", lambda x: x["words"]), threshold)
    placed = control.select("control_id", "n_votes", F.explode(F.arrays_zip(homes.alias("home"), F.col("like"))).alias("x")).select("control_id", "n_votes", "x.home", "x.like.*")
    group = ["control_id", "home"]
    placed = placed.withColumn("of_type", F.sum("n").over(Window.partitionBy(*group, "type")))
    priority = F.coalesce(F.nullif(_rank("type", ARTIFACT_TYPES), F.lit(0)), F.lit(len(ARTIFACT_TYPES) + 1))
    rolled = placed.groupBy(*group).agg(
        F.first("n_votes").alias("n_votes"), *least, F.min_by("type", F.struct(-F.col("of_type"), priority)).alias("type"),
        F.sort_array(F.collect_list(F.struct("at", "properties"))).alias("properties"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("voters")))).alias("voters"),
    )
    share = F.size("voters") / F.col("n_votes")
    return rolled.select(
        "control_id", *[F.coalesce(F.col(f)["value"], F.lit("")).alias(f) if f in first else F.col(f) for f in fields], _first_values(F.col("properties")).alias("properties"),
        "voters", (F.floor(share * 1000 + 0.5) / 1000).alias("confidence"), (F.size("voters") == F.col("n_votes")).alias("unanimous"),
    )


def _words(name: F.Column) -> F.Column:
    """The different words of the normal name, in order, as one text; a leading article is none."""
    name = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), SPACE + r"+\z", "")
    name = F.regexp_replace(name, rf"\.+\z|\A{SPACE}+", "")
    name = F.regexp_replace(name, rf"\A(the|a|an)({SPACE}+|\z)", "")
    words = F.filter(F.split(name, SPACE + "+"), lambda w: w != "")
    return F.array_join(F.sort_array(F.array_distinct(words)), " ")


def _homes(words: F.Column, threshold: float) -> F.Column:
    """For each of some names' words the number of the group that it joins or opens, gone through in order."""
    none = F.struct(F.array().cast("array<array<string>>").alias("heads"), F.array().cast("array<int>").alias("homes"))

    def met(head: F.Column, own: F.Column) -> F.Column:
        return (F.size(own) > 0) & (F.size(head) > 0) & (F.size(F.array_intersect(head, own)) / F.nullif(F.least(F.size(head), F.size(own)), F.lit(0)) >= threshold)

    def placed(sofar: F.Column, words: F.Column) -> F.Column:
        own = F.filter(F.split(words, " "), lambda w: w != "")
        home = F.array_position(F.transform(sofar["heads"], lambda h: F.coalesce(met(h, own), F.lit(False))), True).cast("int")
        opened = F.struct(F.array_append(sofar["heads"], own).alias("heads"), F.array_append(sofar["homes"], F.size(sofar["heads"]) + 1).alias("homes"))
        return F.when(home == 0, opened).otherwise(F.struct(sofar["heads"].alias("heads"), F.array_append(sofar["homes"], home).alias("homes")))

    return F.aggregate(words, none, placed, lambda sofar: sofar["homes"])


def _first_values(properties: F.Column) -> F.Column:
    """One map of some (at, properties) in order: of each key the first value."""
    entries = F.flatten(F.transform(F.filter(properties, lambda x: x["properties"].isNotNull()), lambda x: x["properties"]))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(F.filter(entries, lambda e: e["key"] == k), F.lit(0))["value"]))
