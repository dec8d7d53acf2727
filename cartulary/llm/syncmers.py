"""Document fingerprints of closed syncmers.

A k-mer (k characters) is an anchor if the smallest hash among its inner s-mers is that of its first or its last one.
Whether it is depends on nothing around it, so texts that share a passage share its anchors, at matching positions.

A fingerprint holds all anchors of a text with their positions, however long it is. Of two texts the n-th anchor of a
hash in one is that of the other; two fingerprints are compared by the anchors that both have in the same order
(longest increasing chain of positions), over all that either has.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.shared import table, with_columns

K, S = 24, 8
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
HASH_BITS = 48
#: A batch is handed on when its texts have so many characters: fingerprints are longer than texts.
CHARACTERS = 1_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _runs(x: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` (a power of two) neighbours, from those of its halves."""
    size, factor = 1, _MIX[0]
    while size < n:
        x = x[:-size] * factor + x[size:]
        factor = factor * factor
        size *= 2
    return x


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of every ``n`` neighbours."""
    size = 1
    while size * 2 <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers of a text; one that is shorter than k is its own only anchor."""
    with np.errstate(over="ignore"):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        if len(points) < k:
            whole = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            return np.zeros(min(len(points), 1), np.int64), np.full(min(len(points), 1), whole, np.uint64)
        inner = _mixed(_runs(_mixed(points + np.uint64(1)), s))
        last = k - s
        smallest = _least(inner, last + 1)
        at = np.flatnonzero((inner[: len(smallest)] == smallest) | (inner[last:] == smallest))
        h = np.zeros(len(at), np.uint64)
        for offset in (*range(0, last, s), last):
            h = h * _MIX[0] + inner[at + offset]
        return at, _mixed(h)


@dataclass(eq=False)
class Fingerprint:
    """Hashes of all anchors and their positions, in order of position."""

    hashes: np.ndarray
    at: np.ndarray

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and np.array_equal(self.hashes, other.hashes) and np.array_equal(self.at, other.at)

    def identities(self) -> np.ndarray:
        """A hash for each anchor, of its own and how many before it are the same."""
        if len(self.hashes) == 0:
            return self.hashes
        order = np.argsort(self.hashes, kind="stable")
        inner = self.hashes[order]
        place = np.arange(len(inner))
        first = np.maximum.accumulate(np.where(np.append(True, inner[1:] != inner[:-1]), place, 0))
        out = np.empty(len(inner), np.uint64)
        with np.errstate(over="ignore"):
            out[order] = _mixed(inner + (place - first).astype(np.uint64) * _MIX[0])
        return out


def sketch(text: str) -> Fingerprint:
    at, h = anchors(text)
    return Fingerprint(h >> np.uint64(64 - HASH_BITS), at)


def written(fingerprint: Fingerprint) -> str:
    """hash@position,... in order of position."""
    return ",".join(map("%x@%d".__mod__, zip(fingerprint.hashes.tolist(), fingerprint.at.tolist(), strict=True)))


def read(fingerprint: str) -> Fingerprint:
    pairs = [x.split("@") for x in fingerprint.split(",") if x]
    return Fingerprint(np.array([int(h, 16) for h, _ in pairs], np.uint64), np.array([int(p) for _, p in pairs], np.int64))


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """From 0 (no anchor in common) to 1 (equal); two fingerprints without anchors are equal."""
    if a == b:
        return 1.0
    one, two = a.identities(), b.identities()
    both, i, j = np.intersect1d(one, two, return_indices=True)
    follow = j[np.argsort(i)]  # the places in b of what a has too, in a's order
    length = len(follow)
    if length and (follow[1:] < follow[:-1]).any():
        chain: list[int] = []
        for p in follow.tolist():
            k = bisect_left(chain, p)
            chain[k : k + 1] = [p]
        length = len(chain)
    return length / (len(one) + len(two) - len(both)) if len(one) + len(two) else 0.0


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """The rows (doc_id, text) dealt into ``parts`` ranges of doc_id, each range in order and closed by a sentinel: a
    copy of the row that follows its last one (after the very last: the first).

    Equal doc_ids are ordered by text, null ones come first; a null text is empty. doc_id must be an integer. To the
    driver go ``parts`` boundaries and first ids, nothing else. One shuffle moves the texts.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_key"), F.coalesce("text", F.lit("")).alias("text"))
    steps = [i / parts for i in range(1, parts)]
    cuts = keyed.agg(F.percentile_approx("_key", steps or [0.5], 10 * parts + 1000)).first()[0] or []
    bounds = spark.sparkContext.broadcast(np.unique(np.array(cuts, np.int64)) if steps else np.empty(0, np.int64))

    @F.pandas_udf("int")
    def part(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, key.to_numpy(), side="left"))

    dealt = keyed.withColumn("_part", part("_key"))
    heads = sorted((r["_part"], r["_key"]) for r in dealt.select("_part", "_key").groupBy("_part").agg(F.min("_key").alias("_key")).collect())
    if not heads:
        return dealt.withColumn("_sentinel", F.lit(False))
    before = [(heads[i - 1][0], key) for i, (_, key) in enumerate(heads)]
    firsts = F.broadcast(spark.createDataFrame(before, "_part int, _key long"))  # one row a range
    sentinels = (
        keyed.join(firsts, "_key")
        .groupBy("_part")
        .agg(F.min("text").alias("text"))
        .select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(2**63 - 1).alias("_key"), "text", "_part", F.lit(True).alias("_sentinel"))
    )
    both = dealt.withColumn("_sentinel", F.lit(False)).unionByName(sentinels)
    return both.repartition(max(parts // 4, 1), "_part").sortWithinPartitions("_part", "_sentinel", "_key", "text")


def compared(docs: DataFrame, parts: int) -> DataFrame:
    """Fingerprints each text and its edited form, and compares them with it and with the next document.

    Only doc_id (an integer) and text are read; other columns are not carried, whatever their names. A null text is
    empty. Rows of one doc_id follow each other in the order of their texts; null doc_ids come first. An empty table
    gives no rows. All rows of one doc_id, or without any, lie in one range.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

    def run(batches):
        own = None  # part, doc_id, text, fingerprint of the row that waits for its next one
        for batch in batches:
            types = {"doc_id": batch.schema.field("doc_id").type, "near_edited": pa.float64(), "near_next": pa.float64()}
            types |= dict.fromkeys(("edited_sha256", "fingerprint", "edited_fingerprint"), pa.string())
            out, size = {k: [] for k in names}, 0
            for part, sentinel, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("_part", "_sentinel", "doc_id", "text")), strict=True):
                found = sketch(text)
                if own is not None and own[0] == part:
                    half = len(own[2]) // 2
                    edited = own[2][: len(own[2]) - half] + text[:half]
                    changed = sketch(edited)
                    row = (
                        own[1], len(own[2]), hashlib.sha256(edited.encode()).hexdigest(), written(own[3]), written(changed),
                        likeness(own[3], changed), likeness(own[3], found),
                    )
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
                    size += len(own[2])
                own = None if sentinel else (part, doc_id, text, found)
                if size >= CHARACTERS:
                    yield with_columns(batch, [], out, types)
                    out, size = {k: [] for k in names}, 0
            yield with_columns(batch, [], out, types)

    return with_next(docs, parts).mapInArrow(
        run,
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``fingerprint``; a null text is fingerprinted as an empty one."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: written(sketch(x or "")))

    return docs.withColumn("fingerprint", run(F.coalesce(F.col(text), F.lit(""))))


def op5_syncmers(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return compared(docs, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
