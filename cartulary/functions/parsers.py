"""Fields of model responses, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartulary.functions.text import trim_all

#: Relationship types; a smaller index wins ties.
RELATIONSHIPS = (
    "EQUIVALENT", "SUPERSET_OF", "SUBSET_OF", "CONTRIBUTES_TO", "COMPLEMENTS", "PARTIAL", "CONFLICTS_WITH", "NO_RELATIONSHIP",
)
#: Artifact types; a smaller index wins ties.
ARTIFACT_TYPES = ("POLICY", "PROCEDURE", "PLAN", "REPORT", "RECORD", "CONFIGURATION", "MECHANISM", "ROLE", "PROCESS")
CONTRIBUTIONS = ("INTEGRAL_TO", "EXAMPLE_OF")


def _field(text: Column, name: str, value: str = r"(\S+)") -> Column:
    return F.regexp_extract(text, rf"(?i){name}:\s*{value}", 1)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named there or fields of the result are taken."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def relationship(response: Column) -> Column:
    """struct(relationship, contribution, confidence, justification, parse_status). Without a known relationship the
    parse fails and the pair has none; an unknown confidence is LOW."""
    found = F.upper(_field(response, "RELATIONSHIP"))
    ok = found.isin(*RELATIONSHIPS)
    contribution = F.upper(_field(response, "CONTRIBUTION_TYPE"))
    confidence = F.upper(_field(response, "CONFIDENCE"))
    return F.struct(
        F.when(ok, found).otherwise("NO_RELATIONSHIP").alias("relationship"),
        F.when(ok & contribution.isin(*CONTRIBUTIONS), contribution).otherwise("").alias("contribution"),
        F.when(ok & confidence.isin("HIGH", "MEDIUM"), confidence).otherwise("LOW").alias("confidence"),
        F.when(ok, trim_all(_field(response, "JUSTIFICATION", r"([^\n]+)"))).otherwise("").alias("justification"),
        F.when(ok, "OK").otherwise("PARSE_FAIL").alias("parse_status"),
    )


def classification(response: Column) -> Column:
    """struct(type, level) of "type|level"; null for a blank response. No type forces no level."""
    text = trim_all(F.regexp_replace(F.regexp_replace(trim_all(response), r"[\r\n]", ""), r"\.+$", ""))
    parts = F.split(text, r"\|")
    kind, level = F.lower(F.get(parts, F.lit(0))), F.lower(trim_all(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))))
    kind = (
        F.when(kind.contains("technical"), "Technical").when(kind.contains("procedural"), "Procedural").when(kind.contains("both"), "Both").otherwise("None")
    )
    level = (
        F.when(level.contains("strategic"), "Strategic")
        .when(level.contains("operational"), "Operational")
        .when(level.contains("tactical"), "Tactical")
        .when(level.contains("none"), "None")
        .otherwise("Tactical")
    )
    return F.when(text != "", F.struct(kind.alias("type"), F.when(kind == "None", "None").otherwise(level).alias("level")))


def artifacts(response: Column) -> Column:
    """struct(artifacts, parse_status): a block between --- lines counts if it has a name and a known type. Valid blocks
    beat the sentinel for none."""
    text = lambda block, name: trim_all(_field(block, name, r"([^\n]+)"))
    unless_none = lambda x: F.when(F.upper(x) == "NONE", "").otherwise(x)
    reserved = ["ARTIFACT_NAME", "ARTIFACT_TYPE", "FREQUENCY", "OWNER_ROLE", "DESCRIPTION", "ARTIFACTS"]

    def block_of(block: Column) -> Column:
        pattern = r"(?m)^([A-Z][A-Z_]+):[ \t]*([^\n]+?)[ \t]*$"
        names = F.regexp_extract_all(block, F.lit(pattern), F.lit(1))
        values = F.regexp_extract_all(block, F.lit(pattern), F.lit(2))
        pairs = F.filter(F.arrays_zip(names.alias("k"), values.alias("v")), lambda x: ~x["k"].isin(*reserved))

        def last(pairs: Column) -> Column:
            keys = F.array_distinct(F.transform(pairs, lambda x: x["k"]))
            return F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(pairs, lambda x: x["k"] == k), -1)["v"].alias("v")))

        return F.struct(
            text(block, "ARTIFACT_NAME").alias("name"),
            F.upper(_field(block, "ARTIFACT_TYPE")).alias("type"),
            unless_none(text(block, "FREQUENCY")).alias("frequency"),
            unless_none(text(block, "OWNER_ROLE")).alias("owner_role"),
            text(block, "DESCRIPTION").alias("description"),
            F.map_from_entries(_once(pairs, last)).alias("properties"),
        )

    # What names no type cannot be valid, so the rest of it is not looked at.
    named = F.filter(F.split(response, r"\n\s*---\s*\n?"), lambda x: F.upper(_field(x, "ARTIFACT_TYPE")).isin(*ARTIFACT_TYPES))
    blocks = F.transform(F.transform(named, trim_all), block_of)
    good = F.filter(blocks, lambda x: (x["name"] != "") & x["type"].isin(*ARTIFACT_TYPES))
    status = lambda good: F.when(F.size(good) > 0, "OK").when(response.rlike(r"(?i)ARTIFACTS:\s*NONE"), "NONE").otherwise("PARSE_FAIL")
    return _once(good, lambda good: F.struct(good.alias("artifacts"), status(good).alias("parse_status")))


def requirement(response: Column) -> Column:
    """YES or NO behind REQUIRES as a boolean; anything else is no vote."""
    found = F.upper(_field(response, "REQUIRES", r"([A-Za-z]+)"))
    return F.when(found == "YES", True).when(found == "NO", False)
