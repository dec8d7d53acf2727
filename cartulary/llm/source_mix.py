"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words, which makes an expected number of copies of each of its documents (``copies`` lets a
caller set it for each document instead). The whole part of that number is taken for certain. The rest is its inclusion
probability p in one more copy: documents are ranked by the odds of a random number, u / (1 - u), divided by the odds
of their inclusion, p / (1 - p), and taken in that order until the words that are missing are there. The sample's size is
fixed in words: the document at its end is taken in part, so a source's words are its target rounded, whatever the sizes.

The random number is a hash of doc_id, text and seed, so reruns agree. No source is ranked in one task: its documents
are dealt over cells of the rank by a number of cells that follows the source's, the words of the cells are summed up
first, and only within a cell documents are put in order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.llm.byte_grams import buffer, slices
from cartulary.llm.shared import Scratch, table, with_columns
from cartulary.operators.prefix import running

#: The weights of the sources in the order of their names, over and over; the share of all words that the
#: mix has; how often a document may be repeated.
WEIGHTS, SHARE, MOST_COPIES = (5, 2, 1), 1.5, 2
#: About so many documents are put in order at once.
CELL = 2_000

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def n_words(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many words each of the texts has that lie end to end."""
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = starts[:-1][np.diff(starts) > 0]
    first[edges] = inside[edges]
    return np.bincount(np.searchsorted(starts, np.flatnonzero(first), side="right") - 1, minlength=len(starts) - 1).astype(np.int64)


def sized(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, source, size (words) and place, a random number below 2^52 that doc_id, text and ``seed`` give."""
    types = {k: docs.schema[k].dataType.simpleString() for k in ("doc_id", "source")}
    text = F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text).cast("binary"))

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "text")):
            yield with_columns(batch, ["doc_id", "source", "place"], {"size": n_words(*buffer(batch.column("text")))})

    drawn = docs.select("doc_id", "source", F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").alias("place"), text.alias("text"))
    return drawn.mapInArrow(run, f"doc_id {types['doc_id']}, source {types['source']}, place long, size long")


def targets(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, words, n, target) of sources (source, words, n): they share ``SHARE`` of all words by weight, none above
    ``MOST_COPIES`` times its own; what is above is shared out again by weight.

    Shared out to the end, every source below its limit has the same words for each unit of weight. Sources are sorted
    by their limit for a unit of weight: those at their limit come first, and what is left is divided among the others.
    """
    named = running(sources.withColumn("_named", F.col("source").isNull()), ["_named", "source"], {"_at": F.lit(1)}, scratch.write)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("_at") % len(WEIGHTS) + 1).cast("int"))
    weighed = named.withColumn("_weight", weight.cast("long")).withColumn("_limit", MOST_COPIES * F.col("words"))
    weighed = scratch.write(weighed.withColumn("_each", F.col("_limit") / F.col("_weight")))
    total = weighed.agg(F.sum("words").alias("words"), F.sum("_weight").alias("weight")).first()
    ranked = running(weighed, ["_each", "_at"], {"_below": F.col("_limit"), "_used": F.col("_weight")}, scratch.write)
    share = (F.lit(SHARE * (total["words"] or 0)) - F.col("_below")) / (F.lit(total["weight"] or 0) - F.col("_used"))
    free = ranked.withColumn("_share", share).where("_share <= _each")
    least = free.orderBy("_each", "_at").select("_share").first()
    target = F.col("_limit").cast("double") if least is None else F.least(F.col("_weight") * F.lit(least[0]), F.col("_limit").cast("double"))
    return weighed.select("source", "words", "n", target.alias("target"))


def odds(p: Column) -> Column:
    return p / (1 - p)


def pareto(docs: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` (group, size, place, copies, ...) with ``taken``, the words that the mix takes of each, repeats counted.

    ``wanted`` (group, words) has the words to take of each group. Each document has its whole copies, and by rank one
    more until the words are there; so no more can be taken than those and one copy of each, and no less than those.
    """
    whole = F.floor("copies")
    p = F.least(F.greatest(F.col("copies") - whole, F.lit(1e-12)), F.lit(1 - 1e-12))
    u = (F.col("place") + F.lit(0.5)) / F.lit(2.0**52)
    ranked = docs.withColumns({"_whole": whole.cast("long") * F.col("size"), "_rank": odds(u) / odds(p)})
    sure = ranked.groupBy("group").agg(F.sum("_whole").alias("_sure"), F.ceil(F.count("*") / F.lit(CELL)).alias("_cells"))
    wanted = sure.join(wanted.select(F.col("group").alias("_of"), "words"), F.col("group").eqNullSafe(F.col("_of")))
    wanted = wanted.select("_of", (F.col("words") - F.col("_sure")).alias("_missing"), "_cells")
    cell = F.floor(F.col("_rank") / (1 + F.col("_rank")) * F.col("_cells")).alias("_cell")
    dealt = scratch.write(ranked.join(wanted, F.col("group").eqNullSafe(F.col("_of"))).withColumn("_cell", cell).drop("_of", "_cells"))
    cells = dealt.groupBy("group", "_cell").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("group").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("group").alias("_of"), F.col("_cell").alias("_in"), F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_from"))
    placed = dealt.join(cells, F.col("group").eqNullSafe(F.col("_of")) & (F.col("_cell") == F.col("_in"))).drop("_of", "_in")
    inside = Window.partitionBy("group", "_cell").orderBy("_rank", "place", "size").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("_from") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    more = F.least(F.col("size"), F.greatest(F.col("_missing") - upto, F.lit(0)))
    return placed.withColumn("taken", F.col("_whole") + more).drop("_whole", "_rank", "_missing", "_cell", "_from")


def mixed(docs: DataFrame, scratch: Scratch, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of ``docs`` (doc_id, text, source); other columns are not
    carried.

    A null text has no words and nothing of it is taken. A null source is a source of its own, the last one. Each row is
    a document, also where rows or doc_ids repeat; of equal rows, which rank alike, any may be the one that is taken. A
    source without words has the target 0. A text's length has no bound of its own. An empty table gives no rows.
    """
    rows = scratch.write(sized(docs, seed))
    aims = scratch.write(targets(rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")), scratch))
    aims = aims.select(F.col("source").alias("_source"), F.col("words").alias("source_size"), "target")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aimed = rows.join(aims, F.col("source").eqNullSafe(F.col("_source"))).withColumn("copies", copies).withColumnRenamed("source", "group")
    wanted = aims.select(F.col("_source").alias("group"), F.floor(F.col("target") + 0.5).alias("words"))
    return pareto(aimed, wanted, scratch).select("doc_id", "size", "source_size", "target", "taken")


def op11_source_mix(spark, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), Scratch(spark, "op11"))


SQL = r"""
with sizes as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         ('0x' || md5('mix:' || coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, ''))[1:13])::bigint as place
  from documents),
sources as (
  select source, sum(size)::bigint as words, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight, row_number() over (order by source nulls last) as pos
  from sizes group by source),
ranked as (
  select *, 1.5::double * sum(words) over () as mix, sum(weight) over () as weights,
         coalesce(sum(2 * words) over w, 0) as below, coalesce(sum(weight) over w, 0) as used, 2 * words / weight::double as each
  from sources window w as (order by 2 * words / weight::double, pos rows between unbounded preceding and 1 preceding)),
shares as (select arg_min((mix - below)::double / (weights - used), (each, pos)) as share from ranked where (mix - below)::double / (weights - used) <= each),
targets as (select source, words, least(weight * coalesce(share, 'inf'::double), 2.0::double * words) as target from sources, shares),
odds as (
  select s.*, words, target, floor(target / words)::bigint as copies, (place + 0.5::double) / 4503599627370496.0::double as u,
         least(greatest(target / words - floor(target / words), 1e-12::double), 1 - 1e-12::double) as p
  from sizes s join targets t on s.source is not distinct from t.source),
upto as (
  select *, coalesce(sum(size) over (partition by source order by (u / (1 - u)) / (p / (1 - p)), place, size rows between unbounded preceding and 1 preceding), 0) as upto
  from odds)
select doc_id, size::bigint as size, words as source_size, target,
       (copies * size + least(size, greatest(floor(target + 0.5) - copies * words - upto, 0)))::bigint as taken
from upto
"""
