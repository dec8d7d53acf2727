"""Comparing embeddings: all pairs, neighbours, and the matrix's file form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.functions.vectors import METRICS, cosine_of_unit, unit

#: All pairs are compared block against block: one shuffle carries each vector to as many blocks as there are.
BLOCKS = 8


def all_pairs(vectors: DataFrame, ids: str = "id", vector: str = "vector", blocks: int = BLOCKS) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b, similarity the cosine times 100.

    Vectors are dealt into blocks by id; pair (i, j) of blocks, i <= j, is a join key, so the comparison is an equi-join
    of bounded groups rather than one nested loop. Vectors of other lengths, and zero vectors, compare as 0.
    """
    u = vectors.select(F.col(ids).alias("id"), unit(F.col(vector)).alias("v")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = u.withColumn("o", other)
    key = F.struct(F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    sides = left.select("id", "v", "block", key.alias("cell"))
    a = sides.select("cell", F.col("id").alias("id_a"), F.col("v").alias("v_a"), F.col("block").alias("b_a"))
    b = sides.select("cell", F.col("id").alias("id_b"), F.col("v").alias("v_b"), F.col("block").alias("b_b"))
    # Both of one block meet in its own cell only; of two blocks in the cell of the two.
    one_cell = (F.col("b_a") != F.col("b_b")) | (F.col("cell.i") == F.col("cell.j"))
    pairs = a.join(b, "cell").where((F.col("id_a") < F.col("id_b")) & one_cell)
    return pairs.select("id_a", "id_b", (cosine_of_unit(F.col("v_a"), F.col("v_b")) * 100).alias("similarity"))


def top_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """The k most similar pairs, ties by ids; none for k <= 0."""
    return pairs.orderBy(F.col("similarity").desc(), "id_a", "id_b").limit(max(k, 0))


#: Numbers of a block of vectors; a task compares two blocks.
BLOCK_VALUES = 1 << 20
#: Vectors of a block at most.
BLOCK = 16_384
#: Similarities that differ by less are equal: sums of the same numbers may differ by where they stand in a block.
DIGITS = 10
MARGIN = 1e-9
#: Rows of the left block whose similarities a task holds at a time, and those of the right one.
TILE = 256, 8192


def _blocks(known: DataFrame) -> int:
    """How many blocks the vectors ``v`` make: their number follows the numbers in them, so a task's memory is bounded."""
    n, values = known.agg(F.count("*"), F.sum(F.coalesce(F.size("v"), F.lit(0)).cast("long"))).first()
    return max(-(-n // BLOCK), -(-(values or 0) // BLOCK_VALUES), 1)


def _named(vectors: DataFrame, ids: str, vector: str) -> DataFrame:
    """(id, v): vectors of floats stay floats where they are shuffled."""
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    return vectors.where(F.col(ids).isNotNull()).select(F.col(ids).alias("id"), F.col(vector).cast(kind).alias("v"))


def _units(rows: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (places, unit vectors in double) of vectors; zero vectors stay, null and empty ones are left out."""
    lengths, units = rows.map(lambda v: 0 if v is None else len(v)).to_numpy(int), {}
    values = rows.to_numpy()
    for n in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == n)
        m = np.stack([values[i] for i in at]).astype(float)
        size = np.linalg.norm(m, axis=1, keepdims=True)
        units[int(n)] = at, np.divide(m, size, out=np.zeros_like(m), where=size > 0)
    return units


def _tiles(n: int, m: int, left: dict, right: dict):
    """(a, b, similarities of rows a to rows b) of two blocks of n and m vectors: the cosine times 100, 0 for other lengths."""
    for b in range(0, m, TILE[1]):
        for a in range(0, n, TILE[0]):
            rows, columns = np.arange(a, min(a + TILE[0], n)), np.arange(b, min(b + TILE[1], m))
            s = None
            for size, (at, x) in left.items():
                to, y = right.get(size, (np.zeros(0, int), x[:0]))
                low, high = np.searchsorted(at, (a, a + len(rows)))
                first, last = np.searchsorted(to, (b, b + len(columns)))
                product = x[low:high] @ y[first:last].T
                product *= 100
                if np.isnan(x[low:high]).any() or np.isnan(y[first:last]).any():
                    product[np.isnan(product)] = -np.inf
                if product.shape == (len(rows), len(columns)):
                    s = product
                else:
                    s = np.zeros((len(rows), len(columns))) if s is None else s
                    s[np.ix_(at[low:high] - a, to[first:last] - b)] = product
            yield rows, columns, np.zeros((len(rows), len(columns))) if s is None else s


class _Best:
    """The ``k`` best of each of ``n`` vectors, ties by place: what is offered is compared with the least that a vector
    holds, and only what passes is sorted."""

    def __init__(self, n: int, k: int, least: float | None = None):
        self.k, self.floor = k, np.full(n, -np.inf if least is None else least)
        self.fresh, self.least, self.held, self.waiting = np.ones(n, bool), least, [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))], 0

    def offer(self, own: np.ndarray, other: np.ndarray, s: np.ndarray, axis: int = 0) -> None:
        """Similarities of ``own`` (along ``axis``) to ``other``; -inf is none."""
        if self.k <= 0:
            return
        floor = self.floor[own]
        if len(other) > self.k and self.fresh[own].any():
            floor = np.maximum(floor, np.partition(s, len(other) - self.k, axis=1 - axis).take(len(other) - self.k, axis=1 - axis) - MARGIN)
            self.floor[own], self.fresh[own] = floor, False
        hit = np.flatnonzero((s >= (floor[:, None] if axis == 0 else floor[None]) - MARGIN).ravel())
        v = s.ravel()[hit]
        hit, v = hit[v > -np.inf], v[v > -np.inf]
        at = np.divmod(hit, s.shape[1])
        self.held.append((own[at[axis]], other[at[1 - axis]], np.round(v, DIGITS)))
        self.waiting += len(hit)
        if self.waiting > max(2 * self.k * len(self.floor), 1 << 18):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, other, values = (np.concatenate(x) for x in zip(*self.held, strict=True))
        if self.least is not None:
            own, other, values = (x[values >= self.least] for x in (own, other, values))
        order = np.lexsort((other, -values, own))
        own, other, values = own[order], other[order], values[order]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        last = place == self.k - 1
        self.floor[own[last]] = values[last]
        self.held, self.waiting = [(own[place < self.k], other[place < self.k], values[place < self.k])], 0
        return self.held[0]


def _cells(vectors: DataFrame, ids: str, vector: str, compare, schema: str) -> DataFrame:
    """``compare(ids, ids, unit vectors by length, same of the other block, whether both are one)`` for every two blocks of
    vectors, each block also with itself; ids of a block are in order.

    The number of blocks follows the number of vectors, so a task's work is bounded; a vector goes to every block once.
    """
    known = _named(vectors, ids, vector)
    blocks = _blocks(known)
    dealt = known.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    dealt = dealt.select("id", "v", (F.col("block") <= F.col("o")).alias("first"), F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        same = bool((frame["i"] == frame["j"]).all())
        sides = [frame[frame["first"] == side].sort_values("id", kind="stable") for side in ((True, True) if same else (True, False))]
        return compare(*[x["id"].to_numpy() for x in sides], *[_units(x["v"]) for x in sides], same)

    return _dealt(dealt, blocks * (blocks + 1) // 2).applyInPandas(run, schema)


def _dealt(rows: DataFrame, cells: int):
    """Rows grouped by cell (i, j), with as many partitions as there are cells, so that few share a task."""
    return rows.repartition(min(cells, 4096), "i", "j").groupBy("i", "j") if cells > 1 else rows.groupBy("i", "j")


def most_similar(vectors: DataFrame, k: int, ids: str = "id", vector: str = "vector") -> DataFrame:
    """(id_a, id_b, similarity) of the k most similar pairs, id_a < id_b, ties by ids; none for k <= 0.

    The best of each two blocks are found where the blocks meet; only they leave the task.
    """
    kind = vectors.schema[ids].dataType.simpleString()

    def compare(left, right, own, other, same):
        best, least = (left[:0], left[:0], np.zeros(0)), -np.inf
        for rows, columns, s in _tiles(len(left), len(right), own, other) if k > 0 else ():
            if same:
                if columns[-1] <= rows[0]:
                    continue
                s[rows[:, None] >= columns[None]] = -np.inf
            hit = np.flatnonzero((s >= least - MARGIN).ravel() if least > -np.inf else s.ravel() > -np.inf)
            if not len(hit):
                continue
            v = np.round(s.ravel()[hit], DIGITS)
            if len(v) > k:
                enough = v >= np.partition(v, len(v) - k)[len(v) - k]
                hit, v = hit[enough], v[enough]
            x, y = left[rows[hit // s.shape[1]]], right[columns[hit % s.shape[1]]]
            found = [np.concatenate(z) for z in zip(best, (np.where(x < y, x, y), np.where(x < y, y, x), v), strict=True)]
            order = np.lexsort((found[1], found[0], -found[2]))[:k]
            best = tuple(z[order] for z in found)
            least = best[2][-1] if len(order) == k else -np.inf
        return pd.DataFrame({"id_a": best[0], "id_b": best[1], "similarity": best[2]})

    found = _cells(vectors, ids, vector, compare, f"id_a {kind}, id_b {kind}, similarity double")
    return top_pairs(found, k)


def most_similar_of_each(vectors: DataFrame, k: int, ids: str = "id", vector: str = "vector") -> DataFrame:
    """(source_id, target_id, similarity, rank) of the k vectors most similar to each, ties by id.

    Each two blocks give at most k targets a vector; only they are shuffled.
    """
    kind = vectors.schema[ids].dataType.simpleString()

    def compare(left, right, own, other, same):
        there, back = _Best(len(left), k), _Best(len(right), 0 if same else k)
        for rows, columns, s in _tiles(len(left), len(right), own, other) if k > 0 else ():
            if same:
                s[rows[:, None] == columns[None]] = -np.inf
            there.offer(rows, columns, s)
            back.offer(columns, rows, s, 1)
        return _found((there, left, right), (back, right, left))

    found = _cells(vectors, ids, vector, compare, f"source_id {kind}, target_id {kind}, similarity double")
    return top_of_each(found, "source_id", "target_id", "similarity", k)


def _found(*sides: tuple[_Best, np.ndarray, np.ndarray]) -> pd.DataFrame:
    columns = []
    for best, own, other in sides:
        rows, places, values = best.settle()
        columns.append((own[rows], other[places], values))
    return pd.DataFrame(dict(zip(("source_id", "target_id", "similarity"), map(np.concatenate, zip(*columns, strict=True)), strict=True)))


def most_similar_between(sources: DataFrame, targets: DataFrame, k: int, least: float | None = None, ids: str = "id", vector: str = "vector") -> DataFrame:
    """(source_id, target_id, similarity, rank) of the k targets most similar to each source, ties by id; none of another
    id's own, and none below ``least``. Each two blocks of sources and targets meet in a task, and only their best leave it.
    """
    kind = sources.schema[ids].dataType.simpleString()
    known = [_named(df, ids, vector) for df in (sources, targets)]
    n, m = map(_blocks, known)
    own, every = lambda blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)), lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    dealt = known[0].select("id", "v", F.lit(True).alias("source"), own(n).alias("i"), every(m).alias("j"))
    dealt = dealt.unionByName(known[1].select("id", "v", F.lit(False).alias("source"), every(n).alias("i"), own(m).alias("j")))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sides = [frame[frame["source"] == side].sort_values("id", kind="stable") for side in (True, False)]
        names = [x["id"].to_numpy() for x in sides]
        best = _Best(len(names[0]), k, least)
        both = np.isin(names[0], names[1])
        for rows, columns, s in _tiles(len(names[0]), len(names[1]), *[_units(x["v"]) for x in sides]) if k > 0 else ():
            if both[rows].any():
                s[names[0][rows][:, None] == names[1][columns][None]] = -np.inf
            best.offer(rows, columns, s)
        return _found((best, *names))

    found = _dealt(dealt, n * m).applyInPandas(run, f"source_id {kind}, target_id {kind}, similarity double")
    return top_of_each(found, "source_id", "target_id", "similarity", k)


def nearest(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", ids: str = "id", vector: str = "vector") -> DataFrame:
    """The k rows nearest to a vector, with similarity = 1 - distance; ties by id."""
    if k <= 0:
        raise ValueError("the limit must be positive")
    if not query:
        raise ValueError("the query vector is empty")
    distance = METRICS[metric](F.col(vector), F.array(*map(F.lit, map(float, query))))
    found = vectors.select(F.col(ids).alias("id"), distance.alias("distance")).orderBy("distance", "id").limit(k)
    return found.withColumn("similarity", 1 - F.col("distance"))


def find_similar(store: DataFrame, tenant: str, catalog: str, model: str, query: list[float], k: int) -> DataFrame:
    """``nearest`` among one tenant's vectors of a catalog and model; it is an error if there are none."""
    own = store.where((F.col("tenant_id") == tenant) & (F.col("catalog_id") == catalog) & (F.col("model") == model))
    if own.isEmpty():
        raise LookupError(f"no vectors of model {model} in catalog {catalog}")
    return nearest(own, query, k, ids="control_id")


def top_of_each(pairs: DataFrame, source: str, target: str, score: str, k: int, *order: Column) -> DataFrame:
    """The k highest-scored targets of each source, ties by target."""
    w = Window.partitionBy(source).orderBy(F.col(score).desc(), *(order or (F.col(target),)))
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def matrix_rows(pairs: DataFrame, ids: list[str]) -> DataFrame:
    """The similarity matrix, a row for each id: its id and a column for every id, as %.2f; the diagonal is 100.

    ``ids`` are the columns of a file for people; a long frame serves everything else.
    """
    both = pairs.select(F.col("id_a").alias("id"), F.col("id_b").alias("other"), "similarity").union(pairs.select("id_b", "id_a", "similarity"))
    wide = both.groupBy("id").pivot("other", list(ids)).agg(F.first("similarity"))
    cells = [F.format_string("%.2f", F.when(F.col("id") == i, 100.0).otherwise(F.coalesce(F.col(f"`{i}`"), F.lit(0.0)))).alias(str(i)) for i in ids]
    return wide.select(F.col("id").alias(""), *cells)
