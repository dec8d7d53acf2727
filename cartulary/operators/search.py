"""Searching controls by words, ranked by how close together they stand, and by meaning.

A control's words are lexemes with positions: title, then statement, then identifier, each field counted on from the
last position of the one before. Stop words have a position but no lexeme. A word with hyphens is a lexeme as a whole, and
so is each of its parts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.functions.stemmer import lexeme

#: Fields in the order of their positions, and the weight of a hit in each.
FIELDS = {"title": 1.0, "statement": 0.4, "identifier": 1.0}
#: Fixed value: no position is higher.
LAST_POSITION = 16383
#: Fixed value: a word with hyphens between letters, a number with its sign, any other run of letters and digits.
WORD = r"\p{L}[\p{L}\p{N}]*(?:-\p{L}[\p{L}\p{N}]*)+|[-+]?\p{N}+(?:\.\p{N}+)*(?![\p{L}\p{N}])|[\p{L}\p{N}]+"

VECTOR = "array<struct<lexeme:string,pos:int,weight:double>>"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _lexemes(words: pd.Series) -> pd.Series:
    return words.map(lambda own: [lexeme(w) for w in own.split(" ")] if own else [])


def lexemes(text: Column) -> Column:
    """The lexemes of a text by position; null where a stop word stands. A null text has none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    parted = F.transform(words, lambda w: F.when(w.rlike(r"^\p{L}.*-"), F.concat(F.array(w), F.split(w, "-"))).otherwise(F.array(w)))
    # A text's words go to Python as one string with blanks, which no word has, and not as a list of many.
    return _lexemes(F.array_join(F.flatten(parted), " "))


def indexed(controls: DataFrame) -> DataFrame:
    """Adds the column ``_vector`` to controls (title, statement, identifier, ...); to be stored and computed once."""
    out = controls.withColumns({f"_{f}": lexemes(F.col(f)) for f in FIELDS})
    vector, last = F.array().cast(VECTOR), F.lit(0)
    for f, weight in FIELDS.items():
        own = F.transform(f"_{f}", lambda x, i: F.struct(x.alias("lexeme"), F.least(i + last + 1, F.lit(LAST_POSITION)).cast("int").alias("pos"), F.lit(weight).alias("weight")))  # noqa: B023
        out = out.withColumn(f"_{f}", F.concat(vector, F.filter(own, lambda x: x["lexeme"].isNotNull())))
        vector = F.col(f"_{f}")
        last = F.coalesce(F.array_max(F.transform(vector, lambda x: x["pos"])), F.lit(0))
    return out.withColumn("_vector", vector).drop(*[f"_{f}" for f in FIELDS])


def postings(index: DataFrame) -> DataFrame:
    """(lexeme, catalog_id, control_id, pos, weight) of an index, sorted by lexeme where it lies: a query reads little."""
    return index.select("catalog_id", "control_id", F.inline("_vector")).select("lexeme", "catalog_id", "control_id", "pos", "weight").sortWithinPartitions("lexeme")


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """The different lexemes of a query."""
    found = spark.createDataFrame([(query,)], "q string").select(lexemes(F.col("q"))).first()[0]
    return sorted({x for x in found if x is not None})


def cover_density(hits: list[tuple[int, str, float]], n_terms: int) -> float:
    """The rank of a text in which the terms of a query stand at ``hits`` (position, term, weight), by position.

    A cover is a shortest stretch that has all terms. Each adds its number of hits over the sum of their inverse weights,
    divided by one more than the number of other words in it; the next cover begins behind the first hit of this one.
    """
    rank, at = 0.0, 0
    while at < len(hits):
        seen: set[str] = set()
        end = next((k for k in range(at, len(hits)) if seen.add(hits[k][1]) or len(seen) == n_terms), None)
        if end is None:
            break
        seen = set()
        begin = next(k for k in range(end, at - 1, -1) if seen.add(hits[k][1]) or len(seen) == n_terms)
        inside = hits[begin : end + 1]
        noise = (hits[end][0] - hits[begin][0]) - (end - begin)
        if noise < 0:
            noise = (end - begin) // 2
        rank += len(inside) / sum(1 / w for _, _, w in inside) / (1 + noise)
        at = begin + 1
    return rank


@F.pandas_udf(T.DoubleType())
def _rank(hits: pd.Series, n_terms: pd.Series) -> pd.Series:
    return pd.Series([cover_density([(h["pos"], h["lexeme"], h["weight"]) for h in own], n) for own, n in zip(hits, n_terms, strict=True)], dtype="float64")


def ranked(stored: DataFrame, query: str, catalogs: list[str] | None = None) -> DataFrame:
    """(catalog_id, control_id, rank) of the controls in ``postings`` that hold every word of the query. A query without
    words finds nothing. Only postings of the query's lexemes are read and shuffled, by control."""
    terms = query_terms(stored.sparkSession, query)
    own = stored.where(F.col("lexeme").isin(*terms) if terms else F.lit(False))
    own = own.where(F.col("catalog_id").isin(*catalogs)) if catalogs else own
    hits = own.groupBy("catalog_id", "control_id").agg(F.sort_array(F.collect_list(F.struct("pos", "lexeme", "weight"))).alias("hits"))
    every = hits.where(F.size(F.array_distinct(F.transform("hits", lambda h: h["lexeme"]))) == len(terms))
    return every.select("catalog_id", "control_id", _rank("hits", F.lit(len(terms))).alias("rank"))


def found(index: DataFrame, query: str, catalogs: list[str] | None = None) -> DataFrame:
    """The controls of an index that hold every word of the query, with rank, from their own vectors."""
    terms = query_terms(index.sparkSession, query)
    own = index.where(F.col("catalog_id").isin(*catalogs)) if catalogs else index
    wanted = F.array(*map(F.lit, terms)).cast("array<string>")
    own = own.withColumn("_hits", F.filter("_vector", lambda x: F.array_contains(wanted, x["lexeme"])))
    own = own.where((F.size(wanted) > 0) & (F.size(F.array_distinct(F.transform("_hits", lambda h: h["lexeme"]))) == len(terms)))
    by_place = F.sort_array(F.transform("_hits", lambda h: F.struct(h["pos"].alias("pos"), h["lexeme"].alias("lexeme"), h["weight"].alias("weight"))))
    return own.withColumn("rank", _rank(by_place, F.lit(len(terms)))).drop("_vector", "_hits")


def clamped(limit: int) -> int:
    """How many rows a page has: 50 unless told, 1000 at most."""
    return min(limit, 1000) if limit > 0 else 50


def top(hits: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return hits.orderBy(F.col("rank").desc(), "control_id").offset(max(offset, 0)).limit(clamped(limit))


def page(hits: DataFrame, limit: int = 50, offset: int = 0) -> tuple[DataFrame, int, int]:
    """(rows, total, next offset): the rows of ``top`` with their place among all hits, from 1."""
    rows, total = top(hits, limit, offset), hits.count()
    placed = rows.withColumn("place", F.row_number().over(Window.orderBy(F.col("rank").desc(), "control_id")) + max(offset, 0))  # a page's rows
    return placed, total, max(offset, 0) + min(clamped(limit), max(total - max(offset, 0), 0))


def merged(by_words: DataFrame, by_meaning: DataFrame) -> DataFrame:
    """(control_id, identifier, origin): what words found, then what only meaning found."""
    first = by_words.select("control_id", "identifier").dropDuplicates(["control_id"]).withColumn("origin", F.lit("text"))
    rest = by_meaning.select("control_id").distinct().join(first.select("control_id"), "control_id", "left_anti")
    return first.unionByName(rest.select("control_id", F.substring_index("control_id", "/", -1).alias("identifier"), F.lit("semantic").alias("origin")))
