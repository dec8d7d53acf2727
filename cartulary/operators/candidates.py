"""Candidate pairs of controls, by several generators, and their union."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions.text import FOUNDATION_WORDS, has_any, matched_words
from cartulary.operators.similarity import most_similar_between, top_of_each

COLUMNS = ("source_id", "target_id", "score", "weight", "generator", "metadata")
LEVELS = {"strategic": 0, "tactical": 1, "operational": 2}


class Generator(Protocol):
    """Makes candidates (COLUMNS) of sources and targets (control_id, text, level)."""

    name: str

    def generate(self, sources: DataFrame, targets: DataFrame) -> DataFrame: ...


def _candidates(df: DataFrame, score, weight: float, name: str, metadata) -> DataFrame:
    return df.select("source_id", "target_id", score.alias("score"), F.lit(float(weight)).alias("weight"), F.lit(name).alias("generator"), metadata.alias("metadata"))


def _links(df: DataFrame, score, weight: float, name: str, metadata) -> DataFrame:
    return df.select("source_class", "target_class", score.alias("score"), F.lit(float(weight)).alias("weight"), F.lit(name).alias("generator"), metadata.alias("metadata"))


@dataclass
class Classed:
    """The candidates of a product, not listed: a source and a target are one for every link of their classes.

    There are as many classes as controls that differ in what a generator looks at, whatever the number of controls.
    """

    sources: DataFrame  # source_id, source_class
    targets: DataFrame  # target_id, target_class
    links: DataFrame  # source_class, target_class, score, weight, generator, metadata

    def pairs(self) -> DataFrame:
        """All candidates (COLUMNS), listed."""
        return self.sources.join(self.links, "source_class").join(self.targets, "target_class").select(*COLUMNS)

    def counted(self, side: str, *by: str | Column) -> DataFrame:
        """(``side``_id, by, n) for each of the controls of a side ("source" or "target"): in how many candidates it is,
        by columns of the links. Classes are counted, so no pair is made."""
        if side not in ("source", "target"):
            raise ValueError(f"unknown side {side}")
        own, other = (self.sources, self.targets) if side == "source" else (self.targets, self.sources)
        mine, theirs = ("source_class", "target_class") if side == "source" else ("target_class", "source_class")
        links = self.links.join(other.groupBy(theirs).agg(F.count("*").alias("_n")), theirs)
        keys = links.select(mine, "_n", *by)
        summed = keys.groupBy(*[c for c in keys.columns if c != "_n"]).agg(F.sum("_n").alias("n"))
        return own.join(F.broadcast(summed), mine).drop(mine)  # a row a class


@dataclass
class Semantic:
    """The ``top_k`` targets of each source by similarity (0 to 100) of at least ``least``; the score is a hundredth."""

    similarities: DataFrame  # id_a, id_b, similarity
    top_k: int = 10
    least: float = 0.0
    weight: float = 1.0
    name: str = "semantic"

    def generate(self, sources: DataFrame, targets: DataFrame) -> DataFrame:
        m = self.similarities
        both = m.select(F.col("id_a").alias("source_id"), F.col("id_b").alias("target_id"), "similarity").union(m.select("id_b", "id_a", "similarity"))
        found = both.where(F.col("similarity") >= self.least)
        found = found.join(sources.select(F.col("control_id").alias("source_id")), "source_id", "left_semi")
        found = found.join(targets.select(F.col("control_id").alias("target_id")), "target_id", "left_semi")
        top = top_of_each(found, "source_id", "target_id", "similarity", self.top_k)
        shown = F.create_map(F.lit("similarity"), F.format_string("%.2f", "similarity"))
        return _candidates(top, F.col("similarity") / 100, self.weight, self.name, shown)


@dataclass
class SemanticVectors:
    """As ``Semantic``, from the vectors (control_id, vector) of sources and targets: no similarity is written but those
    of the ``top_k`` of each source."""

    vectors: DataFrame
    top_k: int = 10
    least: float = 0.0
    weight: float = 1.0
    name: str = "semantic"

    def generate(self, sources: DataFrame, targets: DataFrame) -> DataFrame:
        own = [self.vectors.join(df.select("control_id").distinct(), "control_id", "left_semi") for df in (sources, targets)]
        top = most_similar_between(*own, self.top_k, self.least, "control_id")
        shown = F.create_map(F.lit("similarity"), F.format_string("%.2f", "similarity"))
        return _candidates(top, F.col("similarity") / 100, self.weight, self.name, shown)


@dataclass
class Keyword:
    """Every source with every target whose text has a foundational word.

    The result is a product by definition; targets without a word go before it. ``classes`` does not list it.
    """

    vocabulary: tuple[str, ...] = FOUNDATION_WORDS
    weight: float = 1.0
    name: str = "keyword"

    def generate(self, sources: DataFrame, targets: DataFrame) -> DataFrame:
        hits = targets.where(has_any(F.col("text"), self.vocabulary)).select(
            F.col("control_id").alias("target_id"), F.array_join(matched_words(F.col("text"), self.vocabulary), ",").alias("_words")
        )
        pairs = sources.select(F.col("control_id").alias("source_id")).crossJoin(hits)
        return _candidates(pairs, F.lit(1.0), self.weight, self.name, F.create_map(F.lit("keywords"), F.col("_words")))

    def classes(self, sources: DataFrame, targets: DataFrame) -> Classed:
        """Targets by the words they have; all sources are of one class."""
        hits = targets.where(has_any(F.col("text"), self.vocabulary))
        hits = hits.select(F.col("control_id").alias("target_id"), F.array_join(matched_words(F.col("text"), self.vocabulary), ",").alias("target_class"))
        links = hits.select(F.lit("").alias("source_class"), "target_class").distinct()
        found = F.create_map(F.lit("keywords"), F.col("target_class"))
        return Classed(sources.select(F.col("control_id").alias("source_id"), F.lit("").alias("source_class")), hits, _links(links, F.lit(1.0), self.weight, self.name, found))


@dataclass
class Level:
    """Every source with every target of a more strategic level; unknown levels take no part.

    A target is sent to each lower level, so the pairing is an equi-join on the level. ``classes`` does not list it.
    """

    weight: float = 1.0
    name: str = "level"

    def generate(self, sources: DataFrame, targets: DataFrame) -> DataFrame:
        t = self._at(targets, "target_id", "at").select("target_id", F.explode(F.expr("filter(sequence(0, 2), x -> x > at)")).alias("at"))
        pairs = self._at(sources, "source_id", "at").join(t, "at")
        return _candidates(pairs, F.lit(1.0), self.weight, self.name, F.create_map().cast("map<string,string>"))

    def classes(self, sources: DataFrame, targets: DataFrame) -> Classed:
        """Both by level."""
        s, t = self._at(sources, "source_id", "source_class"), self._at(targets, "target_id", "target_class")
        links = s.select("source_class").distinct().select("source_class", F.explode(F.expr("filter(sequence(0, 2), x -> x < source_class)")).alias("target_class"))
        return Classed(s, t, _links(links, F.lit(1.0), self.weight, self.name, F.create_map().cast("map<string,string>")))

    @staticmethod
    def _at(df: DataFrame, name: str, at: str) -> DataFrame:
        index = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
        return df.select(F.col("control_id").alias(name), F.element_at(index, F.lower("level")).alias(at)).where(F.col(at).isNotNull())



def union_first(candidates: DataFrame) -> DataFrame:
    """One row a pair: that of the generator whose name comes first."""
    best = F.min_by(F.struct("score", "weight", "metadata"), F.struct("generator", "score"))
    best = candidates.groupBy("source_id", "target_id").agg(best.alias("c"), F.min("generator").alias("generator"))
    return best.select("source_id", "target_id", "c.score", "c.weight", "generator", "c.metadata")


def union_weighted(candidates: DataFrame, least: float = 0.0) -> DataFrame:
    """One row a pair: the weighted mean score if it is at least ``least``, other fields from the first generator.
    Pairs whose weights add up to nothing are left out."""
    first = F.min_by(F.struct("generator", "metadata"), F.struct("generator", "score"))
    summed = candidates.groupBy("source_id", "target_id").agg(F.sum(F.col("score") * F.col("weight")).alias("_s"), F.sum("weight").alias("_w"), first.alias("_f"))
    scored = summed.where(F.col("_w") != 0).withColumn("score", F.col("_s") / F.col("_w")).where(F.col("score") >= least)
    return scored.select("source_id", "target_id", "score", F.col("_w").alias("weight"), F.col("_f.generator").alias("generator"), F.col("_f.metadata").alias("metadata"))


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"union": lambda c, least=0.0: union_first(c), "weighted_union": union_weighted}


class Registry:
    """Generators by name, run in the order of their names."""

    def __init__(self) -> None:
        self.generators: dict[str, Generator] = {}

    def register(self, generator: Generator) -> None:
        if not generator.name or generator.name in self.generators:
            raise ValueError(f"no name, or one that is taken: {generator.name!r}")
        self.generators[generator.name] = generator

    def _chosen(self, strategy: str, names: list[str] | None) -> list[str]:
        if strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {strategy}")
        chosen = sorted(names if names is not None else self.generators)
        if missing := [n for n in chosen if n not in self.generators]:
            raise LookupError(f"unknown generators {missing}")
        if not chosen:
            raise ValueError("no generator")
        return chosen

    def generate(self, sources: DataFrame, targets: DataFrame, strategy: str, names: list[str] | None = None, least: float = 0.0) -> DataFrame:
        frames = [self.generators[n].generate(sources, targets) for n in self._chosen(strategy, names)]
        return STRATEGIES[strategy](reduce(DataFrame.unionByName, frames), least)

    def classes(self, sources: DataFrame, targets: DataFrame, strategy: str, names: list[str] | None = None, least: float = 0.0) -> Classed:
        """As ``generate``, where all generators have classes: a control's class here is all that they tell of its rows, so
        the strategy unites links of classes as it unites pairs."""
        chosen = self._chosen(strategy, names)
        if listing := [n for n in chosen if not hasattr(self.generators[n], "classes")]:
            raise ValueError(f"generators without classes {listing}")
        own = {n: self.generators[n].classes(sources, targets) for n in chosen}

        def members(side: str) -> DataFrame:
            told = [getattr(c, f"{side}s").select(f"{side}_id", F.struct(F.lit(n).alias("name"), F.col(f"{side}_class").cast("string").alias("class")).alias("c")) for n, c in own.items()]
            return reduce(DataFrame.unionByName, told).groupBy(f"{side}_id").agg(F.sort_array(F.collect_list("c")).alias(f"{side}_class"))

        s, t = members("source"), members("target")
        of = lambda df, side: df.select(F.col(f"{side}_class").alias(f"{side}_id")).distinct().select(f"{side}_id", F.inline(f"{side}_id")).withColumnRenamed("class", f"{side}_class")
        linked = []
        for n, c in own.items():
            links = c.links.withColumns({f"{side}_class": F.col(f"{side}_class").cast("string") for side in ("source", "target")})
            for side, df in (("source", s), ("target", t)):
                links = links.join(of(df, side).where(F.col("name") == n).drop("name"), f"{side}_class")
            linked.append(links.select(*COLUMNS))
        united = STRATEGIES[strategy](reduce(DataFrame.unionByName, linked), least)
        return Classed(s, t, united.withColumnsRenamed({"source_id": "source_class", "target_id": "target_class"}))


def with_provenance(candidates: DataFrame) -> DataFrame:
    """One row a pair: the highest score and all contributions, as they are stored."""
    return candidates.groupBy("source_id", "target_id").agg(
        F.max("score").alias("aggregate_score"), F.sort_array(F.collect_list(F.struct("generator", "score", "weight"))).alias("provenance")
    )


def in_order(stored: DataFrame) -> DataFrame:
    """Stored candidates, best first, with provenance read from its JSON text where it is one."""
    if dict(stored.dtypes).get("provenance") == "string":
        stored = stored.withColumn("provenance", F.from_json("provenance", "array<struct<generator:string,score:double,weight:double>>"))
    return stored.orderBy(F.col("aggregate_score").desc(), "source_id", "target_id")
