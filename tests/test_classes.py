"""Products of controls counted by classes, without listing their pairs."""

import random

import pytest
from pyspark.sql import functions as F

from cartulary.operators import candidates as C


def _controls(spark, seed, n=60):
    """Controls with and without words, some of them twice."""
    rng = random.Random(seed)
    rows = [(f"{rng.randrange(n)}", rng.choice(["a Policy", "plan, policy", "nothing", "", None, "PLAN", "planned policy"]), rng.choice(["Strategic", "TACTICAL", "operational", "", None, "x"])) for _ in range(n)]
    return spark.createDataFrame(rows, "control_id string, text string, level string")


def _listed(df):
    return sorted((r.source_id, r.target_id, r.score, r.weight, r.generator, sorted(r.metadata.items())) for r in df.collect())


def _same(generated, classed):
    """The classes stand for the pairs, and count them, from either side."""
    assert _listed(generated) == _listed(classed.pairs()) != []
    for side in ("source_id", "target_id"):
        got = classed.counted(side.split("_")[0], "generator").groupBy(side, "generator").agg(F.sum("n").alias("n"))
        want = generated.groupBy(side, "generator").agg(F.count("*").alias("n"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def _many(spark, n):
    d = spark.range(n).select(F.col("id").cast("string").alias("control_id"), F.when(F.col("id") % 2 == 0, "a policy").otherwise("b").alias("text"), F.expr("element_at(array('strategic', 'tactical', 'operational', ''), int(id % 4) + 1)").alias("level"))
    return d, d


def test_keyword_classes(spark):
    s, t = _controls(spark, 1), _controls(spark, 2)
    _same(C.Keyword().generate(s, t), C.Keyword().classes(s, t))
    with pytest.raises(ValueError):
        C.Keyword().classes(s, t).counted("both")
    # 20 billion pairs.
    big = C.Keyword().classes(*_many(spark, 200_000)).counted("target")
    assert tuple(big.agg(F.count("*"), F.min("n"), F.max("n")).first()) == (100_000, 200_000, 200_000)


def test_level_classes(spark):
    s, t = _controls(spark, 3), _controls(spark, 4)
    _same(C.Level().generate(s, t), C.Level().classes(s, t))
    big = C.Level().classes(*_many(spark, 200_000)).counted("source")
    assert {tuple(r) for r in big.groupBy("n").count().collect()} == {(50_000, 50_000), (100_000, 50_000)}


@pytest.mark.parametrize(("strategy", "least"), [("union", 0.0), ("weighted_union", 0.4)])
def test_registry_classes(spark, strategy, least):
    r = C.Registry()
    r.register(C.Level(weight=0.5))
    r.register(C.Keyword())
    s, t = _controls(spark, 5), _controls(spark, 6).dropDuplicates(["control_id"])
    _same(r.generate(s, t, strategy, least=least), r.classes(s, t, strategy, least=least))
    big = r.classes(*_many(spark, 100_000), strategy).counted("source", "generator")
    assert big.agg(F.sum("n")).first()[0] == {"union": 50_000 * 100_000 + 25_000 * 25_000, "weighted_union": 50_000 * 100_000 + 25_000 * 25_000}[strategy]
    r.register(C.Semantic(s))
    with pytest.raises(ValueError):
        r.classes(s, t, strategy)
