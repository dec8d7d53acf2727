"""Line deduplication by pairwise alignment.

A document's lines are hashed. A line alone may be in every document, so lines are made rare: each is joined with the
lines behind it, and with those before it, until they have ``min_words`` words. Such a window's hash leads from every
document that has it to the first that has it: a passage that a third of all documents share makes one pair for each
of them, never pairs of them all.

Each pair of an earlier and a later document is aligned by patience diff, anchored on lines that are unique in both;
runs of aligned lines with at least ``min_words`` words are deleted from the later document. One alignment keeps one
order, so it cannot reach a passage that stands elsewhere or twice. What led to the pair and is not deleted yet is aligned
again on the rest: both documents from that place on, where their beginnings agree. Only aligned blocks are deleted.

So a line goes if, and only if, it is in a run of lines of at least ``min_words`` words that some earlier document
has: such a run's lines are all in windows that end within it, and each window has a first holder, against which it is
aligned until it is gone. (Lines without words at the ends of a run go only where they are aligned with it.)

The order of documents is that of (doc_id, row key); a row key is a 64-bit hash of doc_id and text, so repeated rows
of one doc_id are one document and are treated alike.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.shared import SPACE_CLASS, Scratch, table, with_columns

#: Blocks of fewer words stay: licence lines and headings are no copied passages.
MIN_WORDS = 30


def longest_chain(values: list[int]) -> list[int]:
    """Indices of a longest ascending subsequence."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        tops[k : k + 1] = [v]
        at[k : k + 1] = [i]
        before.append(at[k - 1] if k else -1)
    chain, i = [], at[-1] if at else -1
    while i >= 0:
        chain.append(i)
        i = before[i]
    return chain[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions (i, j) of equal items, ascending in both."""
    found, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        places = {}
        for side, (items, lo, hi) in enumerate(((a, a0, a1), (b, b0, b1))):
            for i in range(lo, hi):
                entry = places.setdefault(items[i], ([], []))
                if len(entry[side]) < 2:
                    entry[side].append(i)
        unique = sorted((x[0][0], x[1][0]) for x in places.values() if len(x[0]) == len(x[1]) == 1)
        anchors = [unique[k] for k in longest_chain([j for _, j in unique])]
        found += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        if anchors:
            work += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(found)


def blocks(pairs: list[tuple[int, int]], words: list[int], min_words: int) -> list[int]:
    """Positions in the later document of runs of aligned lines that have enough words."""
    out: list[int] = []
    run: list[int] = []
    for k, (i, j) in enumerate(pairs):
        if k and (i, j) != (pairs[k - 1][0] + 1, pairs[k - 1][1] + 1):
            out += run if sum(words[x] for x in run) >= min_words else []
            run = []
        run.append(j)
    return out + (run if sum(words[x] for x in run) >= min_words else [])


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """key, doc_id, and of each line two hashes and its words."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.regexp_replace(x, SPACE_CLASS + "+$", ""))
    return (
        docs.select(F.xxhash64("doc_id", text).alias("key"), "doc_id", lines.alias("_lines"))
        .select(
            "key",
            "doc_id",
            F.transform("_lines", lambda x: F.xxhash64(x)).alias("h1"),
            F.transform("_lines", lambda x: F.xxhash64(F.lit("second"), x)).alias("h2"),
            F.transform("_lines", lambda x: F.when(x == "", 0).otherwise(F.size(F.split(F.ltrim(x), SPACE_CLASS + "+")))).alias("words"),
        )
        .dropDuplicates(["key"])
    )


def spans(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """The windows (start, end): from each line the fewest lines behind it that together have ``min_words`` words, and
    up to each line the fewest before it. Of lines without words only the first (the last) of a stretch has one."""
    found: set[tuple[int, int]] = set()
    for back in (False, True):
        n, counts = len(words), words[::-1] if back else words
        end, total = 0, 0
        for start in range(n):
            while end < n and total < min_words:
                total += counts[end]
                end += 1
            if total < min_words:
                break
            if counts[start] or start == 0 or counts[start - 1]:
                found.add((n - end, n - start) if back else (start, end))
            total -= counts[start]
    return sorted(found)


def windows(h1: list[int], h2: list[int], words: list[int], min_words: int) -> list[tuple[int, int, int]]:
    """(hash, start, end) of each window."""
    # The hash of a tuple of integers is the same in every process.
    return [(hash((*h1[i:j], *h2[i:j])), i, j) for i, j in spans(words, min_words)]


def aligned(earlier: tuple, later: tuple, hashes: list[int], min_words: int) -> set[int]:
    """Positions in the later document that alignments with the earlier one delete, until no window of ``hashes`` that
    both have is left."""
    wanted, words = set(hashes), later[2]
    a, b = (list(zip(*x[:2], strict=True)) for x in (earlier, later))
    gone = set(blocks(patience(a, b), words, min_words))
    there = {h: (i, j) for h, i, j in windows(*earlier, min_words) if h in wanted}
    for h, start, end in windows(*later, min_words):
        if h in there and not gone.issuperset(range(start, end)):
            i, j = there[h]
            if a[i:j] == b[start:end]:
                reach = 2 * (end - start)  # what goes on beyond is in windows of its own
                again = blocks(patience(a[i : i + reach], b[start : start + reach]), words[start:], min_words)
                gone.update(start + k for k in again)
    return gone


def deletions(lines: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, gone): the positions of the lines that each later document loses."""
    kind = lines.schema["doc_id"].dataType.simpleString()

    def hashes(batches):
        for batch in batches:
            found = [sorted({h for h, _, _ in windows(*x, min_words)}) for x in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "words")), strict=True)]
            yield with_columns(batch, ["key", "doc_id"], {"windows": found}, {"windows": pa.list_(pa.int64())})

    each = scratch.write(lines.mapInArrow(hashes, f"key long, doc_id {kind}, windows array<long>").where(F.size("windows") > 0))
    each = each.select("key", "doc_id", F.explode("windows").alias("h"))
    order = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "key")
    firsts = each.groupBy("h").agg(F.min(order).alias("low"), F.max(order).alias("high")).where("low < high")
    firsts = scratch.write(firsts.select("h", F.col("low.key").alias("first")))
    met = each.join(firsts, "h").where("key <> first")
    pairs = scratch.write(met.groupBy("key", "first").agg(F.collect_list("h").alias("met")))
    scratch.drop(firsts)
    later = lines.select("key", F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("words").alias("bw"))
    earlier = lines.select(F.col("key").alias("first"), F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("words").alias("aw"))
    names = ("met", "a1", "a2", "aw", "b1", "b2", "bw")
    both = pairs.join(later, "key").join(earlier, "first").select("key", *names)

    def align(batches):
        for batch in batches:
            gone = []
            for met, a1, a2, aw, b1, b2, bw in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                gone.append(sorted(aligned((a1, a2, aw), (b1, b2, bw), met, min_words)))
            yield with_columns(batch, ["key"], {"gone": gone}, {"gone": pa.list_(pa.int32())})

    found = both.mapInArrow(align, "key long, gone array<int>").where(F.size("gone") > 0)
    return found.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def dedup(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text and any others) with the deleted lines gone from text, and n_lines, n_deleted and deleted
    (the positions, comma-joined, from 0). Columns so named are replaced; names starting with _ are reserved.

    A null text stays null, with no lines. A text that loses every line is empty.
    """
    gone = scratch.write(deletions(scratch.write(lines_of(docs)), scratch, min_words))  # cut: the texts are read again
    kept = docs.drop("n_lines", "n_deleted", "deleted").withColumn("_key", F.xxhash64("doc_id", "text"))
    renamed = gone.select(F.col("key").alias("_key"), F.col("gone").alias("_gone"))
    joined = kept.join(renamed.hint("merge"), "_key", "left")  # its size has no bound
    split = F.split("text", "\n")
    left = F.array_join(F.filter(F.col("_split"), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    return (
        joined.withColumn("_split", F.when(F.size("_gone") > 0, split))
        .withColumn("n_lines", F.coalesce(F.size(split), F.lit(0)).cast("long"))
        .withColumn("text", F.when(F.size("_gone") > 0, left).otherwise(F.col("text")))
        .withColumn("n_deleted", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
        .withColumn("deleted", F.coalesce(F.array_join("_gone", ","), F.lit("")))
        .drop("_key", "_split", "_gone")
    )


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op7"))
