"""Vector measures as column expressions, and the text form of vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def comparable(a: Column, b: Column) -> Column:
    return (F.size(a) == F.size(b)) & (F.size(a) > 0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 for different lengths, empty vectors and zero norms."""
    length = norm(a) * norm(b)
    return F.when(comparable(a, b) & (length > 0), dot(a, b) / length).otherwise(0.0)


def cosine_of_unit(a: Column, b: Column) -> Column:
    """Of vectors already scaled by ``unit``; then each comparison is one dot product."""
    return F.when(comparable(a, b), dot(a, b)).otherwise(0.0)


def unit(a: Column) -> Column:
    """Scaled to length 1; a zero or empty vector becomes one of zeros."""
    length = norm(a)
    return F.transform(a, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - cosine(a, b)


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


#: The declared distance metrics by name; only cosine ranks neighbours by default.
METRICS = {"cosine": cosine_distance, "euclidean": euclidean, "dot_product": lambda a, b: -dot(a, b)}


def to_text(vector: Column) -> Column:
    """[a,b,...]"""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]"))


def from_text(text: Column) -> Column:
    """The floats of [a,b,...]; null where the text is no vector."""
    inner = F.regexp_extract(F.trim(text), r"^\[(.*)\]$", 1)
    numbers = F.transform(F.split(inner, ","), lambda x: F.trim(x).try_cast("float"))
    good = F.trim(text).rlike(r"^\[.*\]$") & ~F.exists(numbers, lambda x: x.isNull())
    return F.when(good, numbers).when(F.trim(text) == "[]", F.array().cast("array<float>"))
