"""Ranked lexical search over postings kept as a DataFrame.

``indexed`` turns documents into postings in blocks: a row for each term of a run of texts, with the places of the
texts that have it, how often they do and how many terms they have. Rows name the bucket of their term and lie sorted by
it in their file. A block is as large as its run of texts, so a term that every document has makes many rows and none is
large. A row without a term holds the block's doc_ids and, of the texts that have a term, lengths.

``search`` joins the items' terms to the postings, scores each match in whole numbers, sums by item and document, and
ranks within the item. All joins are of blocks, not of matches: a block's postings get their term's weight and items, are
dealt by block, and only there become a row for each match, so that the sums need no further shuffle; Spark cuts each
partition's rows to the best k of an item before they meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.llm.byte_grams import buffer, slices
from cartulary.llm.shared import Scratch, table, with_columns

BUCKETS = 1024
#: Bytes of text in a block, unless one text has more.
BLOCK = 8 << 20
#: About so many items go along with a block of postings at once.
LOT = 1000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def runs(raw: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The maximal runs of ``inside`` bytes of texts that lie end to end, and the text of each."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = starts[:-1][np.diff(starts) > 0]
    first[edges] = inside[edges]
    at = np.flatnonzero(first)
    kept = np.flatnonzero(inside)
    offsets = np.append(np.searchsorted(kept, at), len(kept)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[kept])))
    return words, np.searchsorted(starts, at, side="right") - 1


def counted(words: pa.Array, text: np.ndarray, n_texts: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The different words, and for each pair of word and text its word's number, its text and how often it occurs,
    in the order of numbers."""
    coded = words.dictionary_encode()
    pair, n = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(n_texts, 1) + text, return_counts=True)
    return coded.dictionary, pair // max(n_texts, 1), pair % max(n_texts, 1), n


def indexed(docs: DataFrame) -> DataFrame:
    """Postings of ``docs`` (doc_id, text): bucket, term, block, and for each text of the block that has the term at,
    tf and n_terms. The row whose term is null has those of the block that have any term, and all ids by place."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in (part for whole in batches for part in slices(whole, "text", BLOCK)):
            raw, starts = buffer(batch.column("text"))
            words, text = runs(_LOWER[raw], starts, _TERM[raw])
            terms, number, at, tf = counted(words, text, batch.num_rows)
            n_terms = np.bincount(text, minlength=batch.num_rows)
            ends = np.searchsorted(number, np.arange(len(terms) + 1)).astype(np.int32)
            some = np.flatnonzero(n_terms)
            lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(np.int32)))
            rows = {"at": at, "tf": tf, "n_terms": n_terms[at] if len(at) else at}
            whole = [0, len(some)]
            own = {"at": some, "tf": np.zeros_like(some), "n_terms": n_terms[some]}
            out = {"term": pa.concat_arrays([terms.cast(pa.string()), pa.nulls(1, pa.string())]), "block": np.full(len(terms) + 1, block, np.int64)}
            out |= {k: pa.concat_arrays([lists(ends, rows[k]), lists(whole, own[k])]) for k in rows}
            out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(np.zeros(len(terms) + 1, np.int32), np.int32(batch.num_rows))), pa.concat_arrays([batch.column("doc_id")]))
            yield with_columns(batch, [], out)
            block += 1

    made = docs.select("doc_id", "text").mapInArrow(run, f"term string, block long, at array<int>, tf array<int>, n_terms array<int>, ids array<{kind}>")
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
    return made.withColumn("bucket", bucket).sortWithinPartitions("bucket", "term")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) of items (item_id, text), each once: rows of one item_id are one item."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    term = F.explode(F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))).alias("term")
    return items.select("item_id", term).distinct()


def weight(n_docs: Column, df: Column) -> Column:
    return F.floor(1000 * F.log((2 * n_docs + 2).cast("double") / (2 * df + 1))).cast("long")


def match_score(w: Column, tf: Column, n_terms: Column, n_docs: int, n_all: int) -> Column:
    """The whole-numbered score of a term that occurs ``tf`` times in a text of ``n_terms``."""
    by = lambda x, y: F.call_function("div", x, y)
    m = F.lit(10) + by(F.lit(90) * n_terms * F.lit(n_docs), F.lit(max(n_all, 1)).cast("long"))
    return w * by(F.lit(1_000_000_000) * tf, F.lit(1000) * tf + 8 * m)


def search(docs: DataFrame, items: DataFrame, scratch: Scratch, k: int = 10) -> DataFrame:
    """The ``k`` highest-scoring of ``docs`` (doc_id, text) for each of ``items`` (item_id, text): item_id, rank (from
    1), doc_id, score (above 0). Other columns of either are not carried.

    Equal scores are ordered by doc_id, null last. A null text has no terms; an item without terms, or whose terms no
    document has, gets no rows. Rows of one item_id (null too) are one item with the terms of all. Each row of ``docs``
    is a document, also where rows or doc_ids repeat. Texts are read whole, whatever their length. Empty tables give no
    rows.
    """
    postings = scratch.write(indexed(docs))
    wanted = scratch.write(item_terms(items))
    own = postings.where("term is null")
    counts = own.agg(F.sum(F.size("at")).alias("n"), F.sum(F.aggregate("n_terms", F.lit(0).cast("long"), lambda t, x: t + x)).alias("all")).first()
    n_docs, n_all = counts["n"] or 0, counts["all"] or 0
    terms = wanted.select("term").distinct().withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    met = scratch.write(postings.join(terms, ["bucket", "term"]).select("term", "block", "at", "tf", "n_terms"))
    weights = met.groupBy("term").agg(weight(F.lit(n_docs).cast("long"), F.sum(F.size("at"))).alias("w"))
    lots = F.pmod(F.xxhash64("item_id"), F.lit(max(1, wanted.select("item_id").distinct().count() // LOT)))
    asked = wanted.groupBy("term", lots.alias("lot")).agg(F.collect_list(F.struct("item_id")).alias("items")).join(weights, "term").drop("lot")

    blocks = met.join(asked, "term").join(own.select("block", "ids").hint("merge"), "block")
    docs_of = F.transform("at", lambda i: F.get("ids", i)).alias("doc_id")
    postings_of = F.inline(F.arrays_zip("at", "tf", "n_terms", docs_of))
    matches = blocks.select("block", "items", "w", postings_of).select("block", "at", "doc_id", "w", "tf", "n_terms", F.inline("items"))
    score = match_score(F.col("w"), F.col("tf").cast("long"), F.col("n_terms").cast("long"), n_docs, n_all)
    sums = matches.groupBy("block", "at", "doc_id", "item_id").agg(F.sum(score).alias("score")).where("score > 0")
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return sums.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op13"))


SQL = r"""
with words as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents where text is not null),
lengths as (select r, doc_id, len(terms) as n, terms from words where len(terms) > 0),
totals as (select count(*) as nd, cast(sum(n) as bigint) as nl from lengths),
asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
tfs as (select r, doc_id, n, term, count(*) as tf from (select r, doc_id, n, unnest(terms) as term from lengths) group by all),
weights as (
  select term, cast(floor(1000 * ln((2 * nd + 2)::double / (2 * count(*) + 1))) as bigint) as w
  from tfs, totals where term in (select term from asked) group by term, nd),
scores as (
  select item_id, r, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // nl)))) as bigint) as score
  from asked join weights using (term) join tfs using (term), totals group by item_id, r, doc_id),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last) as k, doc_id, score from scores where score > 0)
select item_id, cast(k as integer) as rank, doc_id, score from ranked where k <= 10
"""
