"""Golden values of scores, reports, vectors, candidates and votes."""

import pytest
from pyspark.sql import functions as F

from cartulary.functions import numeric, vectors
from cartulary.operators import candidates, consensus, similarity, synthesis

VIABILITY = [
    (0.0, "Technical", "Technical", "Tactical", "Tactical", "", 0.0, 0.0),
    (80.0, "Unknown", "Technical", "Tactical", "Tactical", "", 72.0, 72.0),
    (80.0, "None", "Technical", "Tactical", "Tactical", "", 72.0, 72.0),
    (80.0, "Unknown", "Unknown", "Tactical", "Tactical", "", 80.0, 80.0),
    (80.0, "Technical", "Technical", "Unknown", "Tactical", "", 80.0, 80.0),
    (80.0, "Technical", "Procedural", "Tactical", "Tactical", "", 64.0, 64.0),
    (80.0, "Technical", "Technical", "Strategic", "Operational", "", 56.0, 56.0),
    (60.0, "Both", "Technical", "Tactical", "Tactical", "", 60.0, 60.0),
    (80.0, "Technical", "Technical", "Tactical", "Tactical", "INTEGRAL_TO", 80.0, 88.0),
    (33.335, "Technical", "Procedural", "Tactical", "Tactical", "INTEGRAL_TO", 26.67, 29.34),
]


def test_viability(spark):
    df = spark.createDataFrame(VIABILITY, "s double, a string, b string, c string, d string, k string, v double, w double")
    types, levels = (F.col("a"), F.col("b")), (F.col("c"), F.col("d"))
    out = df.select("v", "w", numeric.viability(F.col("s"), types, levels).alias("x"), numeric.viability_weight(F.col("s"), types, levels, F.col("k")).alias("y"))
    assert all((r.v, r.w) == (r.x, r.y) for r in out.collect())


def _rows(spark, rows):
    return spark.createDataFrame(rows, "source_id string, target_id string, score double, confidence double, relationship string, unanimous boolean, viability_weight double")


def test_report_and_diagnostics(spark):
    rows = _rows(spark, [(f"s{i % 2}", f"t{i}", 10.0 * i, 0.5, "EQUIVALENT", i > 2, 1.0) for i in range(1, 9)])
    r = synthesis.report(rows).first()
    assert (r.total, r.iqr, r.contested, r.sources, r.covered_sources) == (8, 35.0, 2, 2, 2)
    assert dict(r.by_relationship) == {"EQUIVALENT": 8}
    levels = {d.name: d.level for d in synthesis.diagnostics(synthesis.report(rows)).collect()}
    assert levels["iqr"] == "good" and levels["no_relationship_rate"] == "warn"
    assert synthesis.diagnostics(synthesis.report(rows.limit(0))).count() == 0
    few = {d.name: (d.level, d.value) for d in synthesis.diagnostics(synthesis.report(rows.limit(3))).collect()}
    assert few["iqr"] == ("warn", 0.0)


def test_cap_and_confidence(spark):
    rows = _rows(spark, [("s1", "t1", 1.0, 0.2, "x", True, 30.0), ("s1", "t2", 1.0, 0.6, "x", True, 90.0), ("s1", "t3", 1.0, 0.9, "x", True, 60.0)])
    assert {r.target_id for r in synthesis.capped(rows, 2).collect()} == {"t2", "t3"}
    assert synthesis.capped(rows, 0).count() == 3
    assert synthesis.confident(rows, 0.6).count() == 2 and synthesis.confident(rows, 0).count() == 3


@pytest.mark.parametrize("bad", [("", "t", 1.0, 0.5), ("s", "t" * 257, 1.0, 0.5), ("s", "t", -1.0, 0.5), ("s", "t", float("nan"), 0.5), ("s", "t", 1.0, 1.5), (None, "t", 1.0, 0.5)])
def test_validation(spark, bad):
    schema = "source_id string, target_id string, score double, confidence double"
    assert synthesis.validated(spark.createDataFrame([("s", "é" * 128, 1.0, 1.0)], schema)).count() == 1
    with pytest.raises(Exception):
        synthesis.validated(spark.createDataFrame([bad], schema)).collect()


def test_store_is_all_or_nothing(spark):
    keys = "job_id string, source_id string, target_id string"
    votes = spark.createDataFrame([("j", "a", "b"), ("j", "a", "c")], keys)
    new = spark.createDataFrame([("j", "a", "b", 5.0)], keys + ", viability_weight double")
    assert {r.target_id: r.viability_weight for r in synthesis.stored(votes, new).collect()} == {"b": 5.0, "c": None}
    with pytest.raises(ValueError):
        synthesis.stored(votes.limit(0), new)


def test_cosine(spark):
    cases = [([1.0, 2.0, 3.0], [4.0, 5.0, 6.0], 0.9746318), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0], [-1.0], -1.0), ([0.0], [1.0], 0.0), ([1.0], [1.0, 2.0], 0.0), ([], [], 0.0)]
    df = spark.createDataFrame(cases, "a array<float>, b array<float>, c double")
    assert all(abs(r.c - r.x) < 1e-6 for r in df.select("c", vectors.cosine(F.col("a"), F.col("b")).alias("x")).collect())


def test_all_pairs_meets_every_pair_once(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(23)], "id long, vector array<float>")
    pairs = similarity.all_pairs(v, blocks=4)
    assert pairs.count() == 23 * 22 // 2 == pairs.select("id_a", "id_b").distinct().count()
    assert similarity.top_pairs(pairs, 0).count() == 0 and similarity.top_pairs(pairs, 999).count() == 253
    m = similarity.matrix_rows(similarity.all_pairs(v.limit(2)), [0, 1]).collect()
    assert m[0]["0"] == "100.00" or m[0]["1"] == "100.00"


def test_find_similar(spark):
    s = spark.createDataFrame([("t", "c", "m", "x", [1.0, 0.0]), ("t", "c", "m", "y", [0.0, 1.0]), ("u", "c", "m", "z", [1.0, 0.0])], "tenant_id string, catalog_id string, model string, control_id string, vector array<float>")
    found = similarity.find_similar(s, "t", "c", "m", [1.0, 0.1], 5).collect()
    assert [r.id for r in found] == ["x", "y"]
    with pytest.raises(LookupError):
        similarity.find_similar(s, "t", "c", "other", [1.0, 0.0], 5)
    with pytest.raises(ValueError):
        similarity.nearest(s, [], 5)


def test_vector_text(spark):
    df = spark.createDataFrame([("[1,2.5]",), ("[]",), ("[a]",), ("1,2",)], "t string")
    assert [r.v for r in df.select(vectors.from_text(F.col("t")).alias("v")).collect()] == [[1.0, 2.5], [], None, None]


def _candidates(spark, rows):
    return spark.createDataFrame(rows, "source_id string, target_id string, score double, weight double, generator string, metadata map<string,string>")


def test_candidate_unions(spark):
    c = _candidates(spark, [("S1", "T1", 0.8, 1.0, "a", {}), ("S1", "T2", 0.7, 1.0, "a", {}), ("S1", "T2", 0.9, 1.0, "b", {}), ("S1", "T3", 0.6, 1.0, "b", {})])
    assert candidates.union_first(c).count() == 3
    w = _candidates(spark, [("S1", "T1", 0.8, 1.0, "a", {}), ("S1", "T1", 0.9, 0.5, "b", {}), ("S1", "T2", 0.5, 1.0, "a", {}), ("S1", "T9", 1.0, 0.0, "a", {})])
    assert [(r.target_id, round(r.score, 3)) for r in candidates.union_weighted(w, 0.6).collect()] == [("T1", 0.833)]


def test_generators(spark):
    schema = "control_id string, text string, level string"
    s = spark.createDataFrame([("a", "x", "Operational"), ("b", "x", ""), ("c", None, "Tactical")], schema)
    t = spark.createDataFrame([("p", "A Policy and plan", "Strategic"), ("q", "nothing", "tactical"), ("r", None, None)], schema)
    assert {(r.source_id, r.target_id) for r in candidates.Level().generate(s, t).collect()} == {("a", "p"), ("a", "q"), ("c", "p")}
    k = candidates.Keyword().generate(s, t).collect()
    assert len(k) == 3 and k[0].metadata == {"keywords": "policy,plan"}
    registry = candidates.Registry()
    registry.register(candidates.Level())
    registry.register(candidates.Keyword())
    assert registry.generate(s, t, "union").count() == 4
    for bad in ("other",):
        with pytest.raises(ValueError):
            registry.generate(s, t, bad)
    with pytest.raises(ValueError):
        registry.register(candidates.Level())


VOTES = [
    ("SUPERSET_OF SUPERSET_OF CONTRIBUTES_TO", "", ("SUPERSET_OF", "", 0.667, False, 3)),
    ("EQUIVALENT SUPERSET_OF", "", ("EQUIVALENT", "", 0.5, False, 2)),
    ("SUPERSET_OF !PARSE_ERROR !PARSE_FAIL", "", ("SUPERSET_OF", "", 1.0, True, 1)),
    ("!PARSE_ERROR !PARSE_FAIL", "", ("NO_RELATIONSHIP", "", 0.0, False, 0)),
    ("CONTRIBUTES_TO CONTRIBUTES_TO CONTRIBUTES_TO", "IIE", ("CONTRIBUTES_TO", "INTEGRAL_TO", 1.0, True, 3)),
    ("CONTRIBUTES_TO CONTRIBUTES_TO SUPERSET_OF", "EE-", ("CONTRIBUTES_TO", "EXAMPLE_OF", 0.667, False, 3)),
    ("CONTRIBUTES_TO CONTRIBUTES_TO", "IE", ("CONTRIBUTES_TO", "INTEGRAL_TO", 1.0, True, 2)),
]


def test_plurality(spark):
    names = {"I": "INTEGRAL_TO", "E": "EXAMPLE_OF"}
    rows = [
        (str(p), f"v{k}", "NO_RELATIONSHIP" if v[0] == "!" else v, names.get((kinds + "---")[k], ""), v[1:] if v[0] == "!" else "OK")
        for p, (votes, kinds, _) in enumerate(VOTES)
        for k, v in enumerate(votes.split())
    ]
    df = spark.createDataFrame(rows, "pair_id string, vote_key string, relationship string, contribution string, parse_status string")
    got = {r.pair_id: r for r in consensus.plurality(df).collect()}
    for p, (votes, _, want) in enumerate(VOTES):
        r = got[str(p)]
        assert (r.relationship, r.contribution, r.confidence_fraction, r.unanimous, r.valid_vote_count) == want
        assert r.all_votes == [v.lstrip("!") for v in votes.split()]


def test_weighted_binary(spark):
    cases = {"a": [(True, 1), (True, 1), (False, 1)], "b": [(True, 1)] * 3, "c": [(True, 1), (False, 1)], "d": [(True, 2), (False, 1), (False, 1)], "e": [(None, 1)], "z": [(True, 0)]}
    rows = [(k, d, float(w)) for k, vs in cases.items() for d, w in vs]
    got = {r.pair_id: r for r in consensus.weighted_binary(spark.createDataFrame(rows, "pair_id string, decision boolean, weight double")).collect()}
    assert got["a"].decision and abs(got["a"].confidence - 2 / 3) < 1e-9
    assert got["b"].unanimous and got["b"].confidence == 1
    assert not got["c"].decision and not got["d"].decision and got["d"].confidence == 0.5
    assert (got["e"].decision, got["e"].confidence) == (False, 0.0)
    assert got["z"].decision


def test_artifact_consensus(spark):
    a = lambda name, kind="POLICY", d="", p=None: (name, kind, "", "", d, p or {})
    rows = [
        ("c", "v1", "OK", [a("Policy Doc", d="short", p={"k": "1"})]),
        ("c", "v2", "OK", [a("The Policy Doc", "PROCEDURE", "a longer one", {"k": "2", "l": "3"})]),
        ("c", "v3", "PARSE_FAIL", None),
        ("d", "v1", "OK", [a("alpha")]),
        ("d", "v2", "OK", [a("beta")]),
    ]
    schema = f"control_id string, vote_key string, parse_status string, artifacts array<struct<{consensus.ARTIFACT.replace(' ', ':').replace(',:', ',')}>>"
    got = consensus.artifact_consensus(spark.createDataFrame(rows, schema)).collect()
    c = next(r for r in got if r.control_id == "c")
    assert (c.name, c.type, c.description, c.confidence, c.voters) == ("Policy Doc", "POLICY", "a longer one", 0.667, ["v1", "v2"])
    assert dict(c.properties) == {"k": "1", "l": "3"}
    assert [r.confidence for r in got if r.control_id == "d"] == [0.5, 0.5]
