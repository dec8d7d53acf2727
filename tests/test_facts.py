"""Graph, tables, catalogs, structure, streams and sources."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cartulary.functions import parsers, text
from cartulary.operators import dag, graph, search, structure, tables
from cartulary.sources import catalogs, files, models, prompts
from cartulary.streaming import bus

FACT = "tenant_id string, id string, label string, source_id string, target_id string, valid_from timestamp, valid_to timestamp, props map<string,string>"
NODE = "tenant_id string, id string, label string, valid_from timestamp, valid_to timestamp, props map<string,string>"
D = lambda *a: datetime(*a)


def _graph(spark):
    nodes = spark.createDataFrame([("t", x, "N", D(2024, 1, 1), None, {}) for x in "abc"] + [("u", "a", "N", D(2024, 1, 1), None, {})], NODE)
    edges = spark.createDataFrame(
        [("t", "old", "E", "a", "b", D(2025, 1, 1), D(2025, 6, 1), {}), ("t", "new", "E", "a", "b", D(2025, 6, 1), None, {}), ("t", "bc", "E", "b", "c", D(2025, 1, 1), None, {}), ("t", "ca", "E", "c", "a", D(2025, 1, 1), None, {})], FACT
    )
    return nodes, edges


@pytest.mark.parametrize(("moment", "want"), [(D(2024, 12, 1), set()), (D(2025, 3, 1), {"old"}), (D(2025, 6, 1), {"new"}), (D(2025, 12, 1), {"new"})])
def test_as_of(spark, moment, want):
    nodes, edges = _graph(spark)
    got = graph.relationships(edges, nodes, "t", moment=moment).where("source_id = 'a'")
    assert {r.id for r in got.collect()} == want
    assert graph.relationships(edges, nodes, "u").count() == 0


def test_traverse(spark):
    nodes, edges = _graph(spark)
    start = spark.createDataFrame([("t", "a")], "tenant_id string, id string")
    paths = graph.traverse(edges, start, 6, moment=D(2025, 7, 1), nodes=nodes).collect()
    assert [(r.end_id, r.hops) for r in sorted(paths, key=lambda r: r.hops)] == [("b", 1), ("c", 2), ("a", 3)]  # no edge twice
    assert {r.end_id for r in graph.traverse(edges, start, 1, "inbound").collect()} == {"c"}
    with pytest.raises(ValueError):
        graph.traverse(edges, start, 1, "sideways")


def test_graph_writes(spark):
    nodes, edges = _graph(spark)
    with pytest.raises(ValueError):
        graph.add_nodes(nodes, nodes.limit(1))
    dangling = edges.where("id = 'bc'").withColumn("id", F.lit("x")).withColumn("target_id", F.lit("nowhere"))
    assert graph.add_edges(edges, nodes, dangling).count() == 4
    closed, hit = graph.supersede(edges, "t", "new", D(2026, 1, 1))
    assert hit and closed.where("id = 'new'").first().valid_to == D(2026, 1, 1)
    assert not graph.supersede(edges, "u", "new", D(2026, 1, 1))[1]


def test_artifact_facts(spark):
    a = spark.createDataFrame([("t", "c1", "The Plan.", "PLAN"), ("t", "c1", "Plan", "PLAN")], "tenant_id string, control_id string, name string, type string")
    nodes, edges = graph.artifact_facts(a, F.lit(D(2025, 1, 1)))
    assert nodes.count() == 1 + 9 and edges.count() == 2


def test_tables(spark):
    with pytest.raises(PermissionError):
        tables.scoped(spark.range(1), "No")
    t = spark.createDataFrame([("k", 1, "first"), ("l", 2, "first")], "id string, v int, created_at string")
    got = {r.id: (r.v, r.created_at) for r in tables.upserted(t, spark.createDataFrame([("k", 9, "second"), ("m", 3, "second")], t.schema), ["id"]).collect()}
    assert got == {"k": (9, "first"), "l": (2, "first"), "m": (3, "second")}
    with pytest.raises(LookupError):
        tables.deleted(t, F.col("id") == "zz", must_exist=True)
    jobs = spark.createDataFrame([("j", "completed")], "job_id string, status string")
    with pytest.raises(PermissionError):
        tables.guarded(jobs, jobs)
    with pytest.raises(PermissionError):
        tables.write_once(t, t, ["id"])
    stages = spark.createDataFrame([("j", "a", "completed", None, None, 0), ("j", "b", "failed", None, None, 0), ("j", "c", "pending", None, None, 0)], "job_id string, stage string, status string, started_at timestamp, completed_at timestamp, retry_count int")
    assert {r.stage: (r.status, r.retry_count) for r in tables.retried(stages, "j", ["a", "b", "c"]).collect()} == {"a": ("completed", 0), "b": ("pending", 1), "c": ("pending", 1)}
    assert tables.page(t, ["id"], limit=5000).count() == 2


def test_chain(spark):
    steps = spark.createDataFrame([("build",), ("ship",)], "step string")
    m = spark.createDataFrame([("ship", "u", "x")], "step string, uri string, digest string")
    p = spark.createDataFrame([("build", "u", "y")], "step string, uri string, digest string")
    assert [(r.made, r.used) for r in tables.broken_links(steps, m, p, ["build", "ship"]).collect()] == [("y", "x")]


def test_dag(spark):
    assert dag.levels(dag.BUILT_IN) == [["artifacts", "classify"], ["embedding"], ["relationship", "requires"]]
    assert set(dag.subset(dag.BUILT_IN, "requires")) == {"requires", "embedding", "classify"}
    with pytest.raises(ValueError):
        dag.levels({"a": ("b",), "b": ("a",)})
    with pytest.raises(LookupError):
        dag.levels({"a": ("x",)})
    r = dag.Registry()
    r.register(dag.Analyzer("a", lambda _: spark.range(3)))
    r.register(dag.Analyzer("b", lambda _: 1 / 0, ("a",)))
    r.register(dag.Analyzer("c", lambda o: o["b"], ("b",)))
    out = r.execute()
    assert out.status == {"a": "completed", "b": "failed", "c": "skipped"} and out.errors == {"b": "failed"}


CATALOG = {
    "catalog": {
        "params": [{"id": "p1", "values": ["daily"]}],
        "groups": [
            {
                "id": "ac",
                "controls": [
                    {
                        "id": "ac-2", "title": "Accounts", "params": [{"id": "p2", "label": "the owner"}],
                        "parts": [{"name": "statement", "prose": "Manage:", "parts": [
                            {"name": "item", "id": "ac-2_smt.a", "prose": "Review {{ insert: param, p1 }}"},
                            {"name": "item", "id": "ac-2_smt.b", "prose": "Ask {{ insert: param, p2 }} and {{ insert: param, p9 }}{{x}}"},
                            {"name": "item", "id": "ac-2_smt.c", "prose": "Both:", "parts": [{"name": "item", "id": "ac-2_smt.c.1", "prose": "one"}, {"name": "item", "prose": "two"}]},
                        ]}],
                        "controls": [{"id": "ac-2.1", "title": "Sub"}],
                    }
                ],
            }
        ],
    }
}


def test_catalog_round_trip(spark):
    docs = spark.createDataFrame([("good", json.dumps(CATALOG)), ("none", "{}"), ("bad", "nope"), ("empty", '{"catalog": {}}')], "path string, content string")
    rows = catalogs.flatten(docs)
    got = {r.id: r for r in rows.where("error is null").collect()}
    assert [(i, got[i]["class"], got[i].parent_id) for i in ("ac-2", "ac-2.a", "ac-2.b", "ac-2.c", "ac-2.c.1", "ac-2.c.2")] == [
        ("ac-2", "section", ""), ("ac-2.a", "requirement", "ac-2"), ("ac-2.b", "requirement", "ac-2"), ("ac-2.c", "section", "ac-2"), ("ac-2.c.1", "requirement", "ac-2.c"), ("ac-2.c.2", "requirement", "ac-2.c"),
    ]
    assert got["ac-2.a"].text == "Review daily" and got["ac-2.b"].text == "Ask the owner and [p9][parameter]"
    assert {r.path for r in rows.where("error is not null").collect()} == {"none", "bad", "empty"}
    assert [r.x for r in docs.select(catalogs.is_catalog(F.col("content")).alias("x")).collect()] == [True, False, False, True]
    made = json.loads(catalogs.assembled(rows.where("error is null"), "T", "1", stamp=False).first().catalog)
    assert made["catalog"]["metadata"]["oscal-version"] == "1.1.3"
    again = catalogs.flatten(spark.createDataFrame([("again", json.dumps(made))], docs.schema))
    assert {r.id for r in again.collect()} >= {"ac-2", "ac-2.a", "ac-2.c.1"}


def test_prose_as_columns(spark):
    df = spark.createDataFrame([("a {{ insert: param, p1 }} b {{ insert: param, zz }}{{q}}", {"p1": "X"})], "t string, p map<string,string>")
    assert df.select(text.resolved_prose(F.col("t"), F.col("p")).alias("x")).first().x == "a X b [zz][parameter]"
    m = spark.createDataFrame([({"a": "1", "b": " "}, {"a": "2"})], "c map<string,string>, o map<string,string>")
    assert m.select(text.collected_params(F.col("c"), F.col("o")).alias("x")).first().x == {"a": "2"}


def test_names(spark):
    df = spark.createDataFrame([(" The  Access   Policy. ", "access policy"), ("the", ""), ("An apple", "apple"), (".", "")], "n string, w string")
    assert all(r.w == r.x for r in df.select("w", text.normal_name(F.col("n")).alias("x")).collect())
    pairs = spark.createDataFrame([("access control policy", "access control plan", 0.6, True), ("access control", "access review", 0.6, False), ("access control", "access review", 0.4, True), ("", "x", 0.1, False)], "a string, b string, t double, w boolean")
    assert all(r.w == r.x for r in pairs.select("w", (text.overlap(F.col("a"), F.col("b")) >= F.col("t")).alias("x")).collect())


def test_parsers(spark):
    r = spark.createDataFrame([("relationship: superset_of\nJustification: because \nconfidence: medium",), ("nothing",), (None,)], "t string")
    got = [x.r for x in r.select(parsers.relationship(F.col("t")).alias("r")).collect()]
    assert (got[0].relationship, got[0].confidence, got[0].justification, got[0].parse_status) == ("SUPERSET_OF", "MEDIUM", "because", "OK")
    assert (got[1].relationship, got[1].parse_status) == ("NO_RELATIONSHIP", "PARSE_FAIL") == (got[2].relationship, got[2].parse_status)
    v = spark.createDataFrame([("REQUIRES: yes",), ("REQUIRES: No.",), ("REQUIRES: maybe",)], "t string")
    assert [x.r for x in v.select(parsers.requirement(F.col("t")).alias("r")).collect()] == [True, False, None]


def test_decompose():
    words = "w " * 10
    assert [r["id"] for r in structure.decompose("x", f"intro\n(a) {words}\n(b) {words}\n(c) {words}{words}")] == ["x.a", "x.b", "x.c"]
    assert len(structure.decompose("x", "(a) one\n(b) two")) == 1
    assert [r["id"] for r in structure.decompose("x", "\n".join(f"{i}. {words}{words}" for i in (1, 2)))] == ["x.1", "x.2"]


def test_structure(spark):
    docs = spark.createDataFrame([("a", "1.1 you shall\n1.2 maybe\n1.3 you must"), ("b", "one\n\ntwo"), ("c", None)], "doc_id string, text string")
    got = [(r.doc_id, r.id) for r in structure.structured(docs, keywords=True).collect()]
    assert sorted(got) == [("a", "1.1"), ("a", "1.3"), ("b", "para-1"), ("b", "para-2")]
    assert structure.chunks("aa\nbb\ncc", 6) == ["aa\nbb", "cc"]
    answers = lambda p: '[{"id": "1", "text": "t"}, 5]' if p.startswith("items:") else "(["
    assert [i["text"] for i in structure.extracted_items("x", answers)] == ["t"] and structure.detected_items("x", answers) == []
    t = spark.createDataFrame([("a", [["k", "v"], [" ", ""], ["z" * 60, "v"]])], "doc_id string, rows array<array<string>>")
    assert sorted(r.id for r in structure.table_items(t).collect())[0] == "k"


def test_search(spark):
    c = spark.createDataFrame([("c", "c/ac-1", "ac-1", "Access control", "Policies for encryption"), ("c", "c/si-1", "si-1", "Integrity", "Detects malicious code"), ("c", "c/sc-1", "sc-1", "Encryption", "Protects")], "catalog_id string, control_id string, identifier string, title string, statement string")
    index = search.indexed(c)
    assert [r.control_id for r in search.top(search.found(index, "malicious code")).collect()] == ["c/si-1"]
    assert [r.control_id for r in search.top(search.found(index, "encryption")).collect()] == ["c/sc-1", "c/ac-1"]
    assert search.found(index, "unknown").count() == 0 == search.found(index, "the").count()
    assert [r.origin for r in search.merged(search.found(index, "encryption"), c).orderBy("origin").collect()] == ["semantic", "text", "text"]


def test_messages(spark):
    with pytest.raises(ValueError):
        bus.subject("a", "b.c")
    m = spark.createDataFrame([("a.b.t", "data", "t", "j", {"sha256": "forged"}), ("a.b.t", "x", "t", None, None)], "subject string, data string, tenant_id string, job_id string, headers map<string,string>")
    p = bus.published(m, "me")
    assert bus.verified(p).count() == 2 and bus.rejected(p.withColumn("data", F.lit("other"))).count() == 2
    assert bus.verified(p.withColumn("headers", F.map_filter("headers", lambda k, v: k != "job_id"))).count() == 0
    with pytest.raises(Exception):
        bus.published(m.withColumn("tenant_id", F.lit("")), "me").collect()


def test_models_and_files(spark, tmp_path):
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise models.Retryable("busy", 0.0)
        return x

    assert models.with_retries(flaky, 1, sleep=lambda s: None) == 1 and len(calls) == 3
    df = spark.createDataFrame([("a b",), (None,)], "text string")
    assert models.embed(df, models.stub_embedder).count() == 2
    assert models.complete(df.withColumnRenamed("text", "prompt"), models.stub_completer).where("error is null").count() == 2
    o = files.Objects(spark, f"file://{tmp_path}", "acme")
    o.put("x/y", b"hello")
    assert o.get("x/y") == b"hello" and o.stat("x/y")["size"] == 5 and o.all().count() == 1
    o.delete("x/y")
    o.delete("x/y")
    assert not o.exists("x/y")
    for bad in ("/a", "../a", "a/../b", ""):
        with pytest.raises(ValueError):
            o.exists(bad)
    r = files.Resolvers()
    r.register("mem", lambda rest: spark.range(int(rest)))
    assert r.resolve("mem://4").count() == 4
    with pytest.raises(LookupError):
        r.resolve("pg://x")


def test_prompts():
    assert prompts.render("a ${b} $c", {"b": "${d}", "e": ""}) == "a ${d} $c"
    with pytest.raises(KeyError):
        prompts.render("${x}", {})
    assert prompts.layered({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}}
    assert prompts.merged({"c": [1]}, {"c": [2]}, lists="append") == {"c": [1, 2]}
