"""Blocks of vectors, the structuring tiers, the graph's entries, and stages that end."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartulary.operators import graph, similarity, structure, tables
from cartulary.sources import graphs, specs
from cartulary.streaming import graph_sink

DAY = datetime(2024, 5, 1)
FACT = "tenant_id string, id string, label string, valid_from timestamp, valid_to timestamp, props map<string,string>"
EDGE = "tenant_id string, id string, label string, source_id string, target_id string, valid_from timestamp, valid_to timestamp, props map<string,string>"


def test_similarity_by_blocks(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=8).round(1).tolist()) for i in range(40)] + [(90, [0.0] * 8), (91, [1.0, 2.0]), (92, None), (93, []), (94, [2.0, 4.0])]
    v = spark.createDataFrame(rows, "id long, vector array<float>")
    want = similarity.all_pairs(v.where("vector is not null"))
    pairs = {(x.id_a, x.id_b): round(x.similarity, 5) for x in want.collect()}
    for block in (4096, 11):
        monkeypatch.setattr(similarity, "BLOCK", block)
        got = {(x.id_a, x.id_b): round(x.similarity, 5) for x in similarity.most_similar(v, 2000).collect()}
        assert {k: s for k, s in got.items() if 92 not in k} == pairs
        best = sorted(pairs.items(), key=lambda x: (-x[1], x[0]))[:7]
        assert [(x.id_a, x.id_b) for x in similarity.most_similar(v, 7).collect()] == [k for k, _ in best]
        each = {}
        for x in similarity.most_similar_of_each(v, 3).collect():
            each.setdefault(x.source_id, []).append((x.rank, round(x.similarity, 5)))
        for i, _ in rows[:40]:
            near = sorted((s for k, s in pairs.items() if i in k), reverse=True)[:3]
            assert [s for _, s in sorted(each[i])] == near
    assert similarity.most_similar(v, 0).count() == 0 and similarity.most_similar(v.limit(0), 5).count() == 0


def test_structuring_tiers(spark):
    kind = "doc_id string, text string, sections array<struct<title:string,text:string>>, rows array<array<string>>"
    lines = "1.1 a\n1.2 b\n1.3 c"
    docs = spark.createDataFrame(
        [
            ("h", lines, [("A", "x"), ("B", "y"), ("R", "1"), ("R", "2"), ("R", "3"), ("R", "4")], [["k", "v"]]),
            ("t", lines, [], [["ac-1", "do it"], [], ["", "no id"], ["x" * 50, "long"]]),
            ("p", lines, None, None),
            ("f", "one\n\n\n\ntwo", None, None),
            ("n", None, None, None),
        ],
        kind,
    )
    got = {}
    for x in structure.structured(docs).orderBy("doc_id", "position").collect():
        got.setdefault(x.doc_id, []).append((x.id, x.title, x.text))
    assert got["h"] == [("sec-1", "A", "x"), ("sec-2", "B", "y")]
    assert got["t"] == [("ac-1", "", "ac-1 | do it"), ("tbl-2", "", " | no id"), ("tbl-3", "", "x" * 50 + " | long")]
    assert got["p"] == [("1.1", "", "1.1 a"), ("1.2", "", "1.2 b"), ("1.3", "", "1.3 c")]
    assert got["f"] == [("para-1", "", "one"), ("para-3", "", "two")] and "n" not in got
    first = structure.structured(docs, pattern=r"^(1\.\d) (.)$").where("doc_id = 'h'").orderBy("position").collect()
    assert [(x.id, x.text) for x in first] == [("1.1", "a"), ("1.2", "b"), ("1.3", "c")]
    asked = structure.structured(docs, complete=lambda prompt: "(o)(n)" if prompt.startswith("pattern:") else "[]").where("doc_id in ('f', 'p')").collect()
    assert [(x.doc_id, x.id) for x in asked if x.doc_id == "f"] == [("f", "o")] and len(asked) == 4


def test_graph_entries(spark):
    nodes = spark.createDataFrame([("a", "n1", "N", DAY, None, {}), ("b", "n1", "N", DAY, None, {})], FACT)
    edges = spark.createDataFrame([("a", f"e{i}", "L", f"n{i}", f"n{(i + 1) % 4}", DAY, None, {}) for i in range(4)], EDGE)
    assert graph.node(nodes, "a", "n1", "N").count() == 1 and graph.edge(edges, "a", "e2", moment=DAY).count() == 1
    for call in (lambda: graph.node(nodes, "a", "n2"), lambda: graph.edge(edges, "b", "e1"), lambda: graph.edge(edges, "a", "e1", moment=datetime(2020, 1, 1))):
        with pytest.raises(LookupError):
            call()
    q = "SELECT n.id, e.id AS e FROM {nodes} n JOIN {edges} e ON e.source_id = n.id WHERE e.label = :l"
    assert [(x.id, x.e) for x in graph.answered(nodes, edges, "a", q, {"l": "L"}).collect()] == [("n1", "e1")]
    with pytest.raises(ValueError):
        graph.answered(nodes, edges, "a", "DROP TABLE x")
    start = spark.createDataFrame([("a", "n0")], "tenant_id string, id string")
    ring = [(x.end_id, x.hops) for x in graph.traverse(edges, start, None).collect()]
    assert sorted(ring) == [("n0", 4), ("n1", 1), ("n2", 2), ("n3", 3)]
    rows, total, following = tables.paged(edges, ["id"], 3)
    assert (rows.count(), total, following) == (3, 4, 3) and tables.paged(edges, ["id"], 3, 3)[2] is None


def test_ended_stages_reach_the_graph(spark, tmp_path):
    ok = '{"job_id": "j1", "analyzer": "relationship"}'
    rows = [("app.pipeline.acme.j1.stage.completed", ok), ("app.pipeline.acme.j1.stage.completed", ok), ("app.acme.x", ok), ("app.pipeline.a b.j1.stage.completed", ok), ("app.pipeline.acme.j2.stage.completed", "no json"), ("app.pipeline.acme.j2.stage.completed", '{"job_id": "j2"}')]
    messages = spark.createDataFrame(rows, "subject string, data string")
    assert [tuple(x) for x in graph_sink.completed(messages).distinct().collect()] == [("acme", "j1", "relationship")]
    kind = "tenant_id string, job_id string, analyzer string, source_id string, target_id string, relationship string, confidence double, analyzed_at timestamp"
    results = spark.createDataFrame([("acme", j, a, "s", t, "EQUIVALENT", 0.5, DAY) for j in ("j1", "j2") for a in ("relationship", "requires") for t in "xy"], kind)
    path = str(tmp_path / "edges")
    source = str(tmp_path / "messages")
    messages.write.parquet(source)
    for turn in range(2):
        stream = spark.readStream.schema(messages.schema).parquet(source).writeStream.foreachBatch(graph_sink.sink(results, path))
        stream.option("checkpointLocation", str(tmp_path / f"c{turn}")).trigger(availableNow=True).start().awaitTermination(60)
    store = graph_sink.EdgeStore(spark, path)
    assert store.log().count() == 2  # another checkpoint is another query
    got = store.edges().select("label", "source_id", "target_id", F.col("props")["job_id"].alias("job"))
    assert sorted(tuple(x) for x in got.collect()) == [("SEMANTIC_MATCH", "s", "x", "j1"), ("SEMANTIC_MATCH", "s", "y", "j1")]


def test_yaml_specs(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("name: relate\nsystem: be brief\nmodels: [x]\n")
    (tmp_path / "b.yml").write_text("name: classify\n")
    (tmp_path / "c.txt").write_text("name: other\n")
    found = specs.prompt_specs(spark, str(tmp_path))
    assert found == {"relate": {"name": "relate", "system": "be brief", "models": ["x"]}, "classify": {"name": "classify"}}
    (tmp_path / "d.yaml").write_text("system: nameless\n")
    with pytest.raises(ValueError):
        specs.prompt_specs(spark, str(tmp_path))
    listed = specs.catalog_documents(spark, "base_url: https://example.org/x/\ndocuments:\n  - path: a/b.json\n  - {path: c.json, local: d.json}\n")
    assert [tuple(r) for r in listed.collect()] == [("a/b.json", "b.json", "https://example.org/x/a/b.json"), ("c.json", "d.json", "https://example.org/x/c.json")]
    for bad in ("- 1", "documents: [{local: x}]", "a: [", ""):
        with pytest.raises(ValueError):
            specs.catalog_documents(spark, bad)


def test_a_failed_job_again_as_a_new_one(spark):
    order = ["classify", "embedding", "graph"]
    jobs = spark.createDataFrame([("j1", "failed", DAY, DAY, DAY), ("j2", "running", DAY, DAY, None)], "job_id string, status string, created_at timestamp, started_at timestamp, completed_at timestamp")
    stages = spark.createDataFrame([("j1", s, t, DAY, DAY, 2) for s, t in zip(order, ("completed", "failed", "pending"), strict=True)], "job_id string, stage string, status string, started_at timestamp, completed_at timestamp, retry_count int")
    later = datetime(2024, 6, 1)
    all_jobs, all_stages = tables.retried_as_new(jobs, stages, "j1", "j3", order, F.lit(later))
    assert sorted(tuple(r) for r in all_jobs.where("job_id <> 'j2'").collect()) == [("j1", "failed", DAY, DAY, DAY), ("j3", "pending", later, None, None)]
    assert {(r.stage, r.status, r.retry_count) for r in all_stages.where("job_id = 'j3'").collect()} == {("classify", "completed", 0), ("embedding", "pending", 0), ("graph", "pending", 0)}
    assert all_stages.where("job_id = 'j1'").count() == 3
    for args, error in ((("j2", "j3"), LookupError), (("j1", "j2"), ValueError)):
        with pytest.raises(error):
            tables.retried_as_new(jobs, stages, *args, order, F.lit(later))


def test_graphs_are_made_and_dropped(spark, tmp_path):
    root = str(tmp_path / "graphs")
    graphs.create(spark, root, "acme")
    nodes, edges = graphs.read(spark, root, "acme")
    assert nodes.count() == edges.count() == 0
    new = spark.createDataFrame([("acme", "n1", "N", DAY, None, {})], FACT)
    graph.add_nodes(nodes, new).write.mode("append").parquet(f"{root}/acme/nodes")
    assert graphs.read(spark, root, "acme")[0].count() == 1
    assert not graphs.create(spark, root, "acme")  # it stays as it is
    graphs.drop(spark, root, "acme")
    assert not graphs.exists(spark, root, "acme")
    for call in (graphs.drop, graphs.read):
        with pytest.raises(LookupError):
            call(spark, root, "acme")
    with pytest.raises(PermissionError):
        graphs.create(spark, root, "../x")
