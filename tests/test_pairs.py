"""Pairs found without comparing all: names by tokens, vectors by blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartulary.functions import text
from cartulary.operators import candidates, similarity


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.6, 1.0])
def test_matching_pairs(spark, threshold):
    rng = random.Random(threshold)
    rows = [(k, rng.choice("xy"), " ".join(rng.choices("abcdefgh", k=rng.randrange(6)))) for k in range(70)] + [(70, "x", ""), (71, "x", "a  a b"), (72, None, "a b"), (73, "x", None)]
    df = spark.createDataFrame(rows, "k int, by string, name string").repartition(3)
    got = [tuple(r) for r in text.matching_pairs(df, "k", "name", ["by"], threshold).collect()]
    words = {k: set((n or "").split()) for k, _, n in rows}
    want = [
        (a, b) for a, x, _ in rows for b, y, _ in rows
        if a < b and x == y and x is not None and words[a] and words[b] and len(words[a] & words[b]) / min(len(words[a]), len(words[b])) >= threshold
    ]
    assert sorted(got) == want


def test_matching_pairs_of_frequent_names(spark, monkeypatch):
    """A name with many keys is the work of several tasks, in lists of bounded length, and no pair is lost or listed twice."""
    monkeypatch.setattr(text, "KEYS", 16, raising=False)
    monkeypatch.setattr(text, "AT_ONCE", 3, raising=False)
    names = ["a b", "a c", "d e"]
    rows = [(k, "x", names[min(k % 8, 2)]) for k in range(400)] + [(7, "x", "a b"), (7, "x", "a c"), (None, "x", "d f"), (None, "x", "a b")]
    pairs = text.matching_pairs(spark.createDataFrame(rows, "k int, by string, name string"), "k", "name", ["by"], 0.5)
    own = [(k, set(n.split())) for k, _, n in rows if k is not None]
    want = sorted((a, b) for a, x in own for b, y in own if a < b and x & y)
    got = pairs.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.k_a, r.k_b) for r in got) == want
    tasks = [r.task for r in got]
    assert max(tasks.count(t) for t in set(tasks)) < 0.6 * len(tasks)


def test_matching_pairs_send_keys_not_pairs(spark, monkeypatch):
    """Four times the keys of frequent names are sixteen times the pairs, but what is shuffled grows with the keys."""
    monkeypatch.setattr(text, "KEYS", 16, raising=False)
    monkeypatch.setattr(text, "AT_ONCE", 4, raising=False)
    sc, none = spark.sparkContext._jsc.sc(), spark._jvm.java.util.ArrayList()

    def shuffled():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    sent = []
    for size in (1000, 4000):
        names = [("a b", "a c", "d e", "d a")[k % 4] for k in range(size)]
        before = shuffled()
        n = text.matching_pairs(spark.createDataFrame([(k, "x", x) for k, x in enumerate(names)], "k int, by string, name string"), "k", "name", ["by"], 0.5).count()
        sent.append(shuffled() - before)
        met = [sum(bool({*x.split()} & {*y.split()}) for y in names[:4]) * size // 4 for x in names]
        assert n == (sum(met) - size) // 2
    assert 0 < sent[1] < 8 * sent[0], sent


def test_most_similar_between(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 7)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(40)] + [(40, [0.0] * 4), (41, [1.0]), (42, None), (43, [1.0, 0.0, 0.0, 0.0]), (44, [2.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    sources, targets = df.where("id % 3 = 0 or id > 39"), df.where("id % 2 = 0 or id > 39")
    vector = {i: v for i, v in rows}

    def cosine(a, b):
        a, b = vector[a] or [], vector[b] or []
        size = np.linalg.norm(a) * np.linalg.norm(b)
        return float(np.dot(a, b) / size * 100) if len(a) == len(b) and size > 0 else 0.0

    ids = lambda df: [r.id for r in df.collect()]
    for k, least in ((3, None), (2, 50.0), (0, None)):
        got = {(r.source_id, r["rank"]): (r.target_id, round(r.similarity, 6)) for r in similarity.most_similar_between(sources, targets, k, least).collect()}
        want = {}
        for a in ids(sources):
            best = sorted((-round(cosine(a, b), 6), b) for b in ids(targets) if b != a and (least is None or cosine(a, b) >= least - 1e-9))
            want |= {(a, i + 1): (b, -s) for i, (s, b) in enumerate(best[:k])}
        assert {p: (t, abs(s)) for p, (t, s) in got.items()} == {p: (t, abs(s)) for p, (t, s) in want.items()}
    named = df.withColumnRenamed("id", "control_id")
    found = candidates.SemanticVectors(named, 2, 50.0).generate(sources.withColumnRenamed("id", "control_id"), targets.withColumnRenamed("id", "control_id"))
    assert found.columns == list(candidates.COLUMNS) and found.where(F.col("score") < 0.5).count() == 0 < found.count()
