"""Prefix sums, quantiles and the report, against Spark's own percentile and against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from cartulary.operators import quantiles, synthesis
from cartulary.operators.prefix import running
from cartulary.operators.stored import stored


@pytest.mark.parametrize("values", [[], [None], [3.0], [1.0, 2.0], [0.1 * k for k in range(101)], [5.0] * 40 + [None, 7.0], [float(random.Random(k).randrange(9)) for k in range(200)]])
def test_quantiles_are_those_of_percentile(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    shares = {"least": 0.0, "low": 0.25, "mid": 0.5, "high": 0.75, "odd": 0.333, "most": 1.0}
    got = quantiles.quantiles(df, "v", shares).first()
    want = df.agg(*[F.percentile("v", s).alias(n) for n, s in shares.items()]).first()
    assert tuple(got) == pytest.approx(tuple(want)) if want[0] is not None else tuple(got) == (None,) * len(shares)


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(100), None if k % 10 == 3 else rng.randrange(50)) for k in range(500)]
    df = spark.createDataFrame(rows, "k long, x long, n long").repartition(7)
    got = {r.k: r.before for r in running(df, ["x", "k"], {"before": F.col("n")}, stored).collect()}
    total, want = 0, {}
    for k, x, n in sorted(rows, key=lambda r: (r[1], r[0])):
        want[k] = total
        total += n or 0
    assert got == want and running(df, ["x", "k"], {"a": F.lit(1), "b": F.col("n")}, stored).columns == ["k", "x", "n", "a", "b"]
    assert running(df.limit(0), ["k"], {"before": F.col("n")}, stored).count() == 0


def test_report_reads_once(spark, tmp_path):
    rng = random.Random(2)
    kinds = ["EQUIVALENT", "NO_RELATIONSHIP", "PARTIAL", "OTHER"]
    rows = [(f"s{rng.randrange(7)}", rng.choice(kinds), float(rng.randrange(12)), rng.random(), rng.choice([0.0, 1.5]), rng.random() < 0.5) for _ in range(300)]
    schema = "source_id string, relationship string, score double, confidence double, viability_weight double, unanimous boolean"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    out = synthesis.report(df)
    r = out.first()
    assert (r.total, r.viable, r.contested, r.no_relationship) == (300, sum(x[4] > 0 for x in rows), sum(not x[5] for x in rows), sum(x[1] == kinds[1] for x in rows))
    assert r.by_relationship == {k: sum(x[1] == k for x in rows) for k in kinds if any(x[1] == k for x in rows)}
    assert (r.sources, r.covered_sources) == (len({x[0] for x in rows}), len({x[0] for x in rows if x[1] in synthesis.ACTIONABLE and x[4] > 0}))
    assert r.avg_confidence == pytest.approx(sum(x[3] for x in rows) / 300) and r.avg_viability == pytest.approx(sum(x[4] for x in rows) / 300)
    want = df.agg(F.percentile("score", 0.75) - F.percentile("score", 0.25)).first()[0]
    assert r.iqr == pytest.approx(want)
    plan = out._jdf.queryExecution().toString()
    assert "percentile" not in plan and str(tmp_path) not in plan  # the input was read before, once
    empty = synthesis.report(df.limit(0)).first()
    assert (empty.total, empty.sources, empty.iqr, empty.by_relationship) == (0, 0, None, {})
    assert synthesis.diagnostics(synthesis.report(df.limit(0))).count() == 0
