"""Blocks of vectors: their best against brute force, in tiles smaller than a block, and how often a vector is sent."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartulary.operators import similarity


def _rows():
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(60)]
    return [*rows, (60, [0.0] * 3), (61, [1.0]), (62, None), (63, [1.0, 0.0, 0.0]), (64, [float("nan"), 1.0, 0.0])]


def _cosine(a, b):
    a, b = a or [], b or []
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return round(float(np.dot(a, b) / size * 100), 9) + 0.0 if len(a) == len(b) and size > 0 else 0.0


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("k", [1, 4, 100])
def test_best_of_blocks(spark, monkeypatch, kind, k):
    monkeypatch.setattr(similarity, "BLOCK", 23)
    monkeypatch.setattr(similarity, "TILE", (5, 7))
    rows = _rows()
    df = spark.createDataFrame(rows, "id long, vector array<double>").withColumn("vector", F.col("vector").cast(f"array<{kind}>")).repartition(3)
    pairs = {(a, b): s for a, v in rows for b, w in rows if a != b and not np.isnan(s := _cosine(v, w))}
    got = {(r.source_id, r["rank"]): r.target_id for r in similarity.most_similar_of_each(df, k).collect()}
    want = {(a, i + 1): b for a, _ in rows for i, (_, b) in enumerate(sorted((-s, b) for (x, b), s in pairs.items() if x == a)[:k])}
    assert got == want
    best = [(r.id_a, r.id_b) for r in similarity.most_similar(df, k).collect()]
    assert best == [p for _, p in sorted((-s, p) for p, s in pairs.items() if p[0] < p[1])[:k]]
    for least in (None, 30.0):
        got = {(r.source_id, r["rank"]): r.target_id for r in similarity.most_similar_between(df.where("id % 3 <> 1"), df, k, least).collect()}
        assert got == {(a, i + 1): b for a, _ in rows if a % 3 != 1 for i, (_, b) in enumerate(sorted((-s, b) for (x, b), s in pairs.items() if x == a and (least is None or s >= least))[:k])}


def test_vectors_are_sent_to_few_blocks_as_they_are(spark):
    vectors = spark.range(30_000).select("id", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vector"))
    known = similarity._named(vectors, "id", "vector")
    assert dict(known.dtypes)["v"] == "array<float>" and similarity._blocks(known) == 2
    assert similarity._blocks(known.select("id", F.array_repeat(F.lit(0.5), 1000).alias("v"))) == 29


def test_a_threshold_does_not_let_everything_through():
    """What is above the threshold is cut to the best before it is held."""
    best = similarity._Best(4, 2, 0.0)
    best.offer(np.arange(4), np.arange(1000), np.random.default_rng(1).random((4, 1000)))
    assert best.waiting == 8
