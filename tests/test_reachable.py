"""Reachability without listing paths, and questions that only read one tenant's facts."""

import random
from datetime import datetime

import pytest

from cartulary.operators import graph

EDGE = "tenant_id string, id string, label string, source_id string, target_id string, valid_from timestamp, valid_to timestamp"
NODE = "tenant_id string, id string, label string, valid_from timestamp, valid_to timestamp, props map<string,string>"
D = [datetime(2025, m, 1) for m in range(1, 8)]


def trails(edges, start, depth, direction):
    """All that paths without repeated edges lead through, by listing them."""
    nodes, taken = {}, {}

    def go(at, used):
        for e, a, b in edges:
            for way, x, y in (("outbound", a, b), ("inbound", b, a)):
                if direction not in (way, "both") or x != at or e in used or len(used) >= depth:
                    continue
                hop = len(used) + 1
                taken[e] = min(hop, taken.get(e, hop))
                nodes[y] = min(hop, nodes.get(y, hop))
                nodes[start] = 0
                go(y, used | {e})

    go(start, frozenset())
    return nodes, taken


@pytest.mark.parametrize(("direction", "depth"), [("outbound", 3), ("inbound", 2), ("both", 3), ("outbound", None), ("both", None)])
def test_reachable_is_what_trails_lead_through(spark, direction, depth):
    rng = random.Random(depth)
    own = [(f"e{k}", rng.choice("abcdef"), rng.choice("abcdefg")) for k in range(9)] + [("loop", "a", "a"), ("back", "b", "a"), ("there", "a", "b")]
    df = spark.createDataFrame([("t", e, "L", a, b, D[0], None) for e, a, b in own] + [("other", "x", "L", "a", "z", D[0], None)], EDGE)
    starts = spark.createDataFrame([("t", "a"), ("t", "c"), ("t", "c"), ("t", "nowhere")], "tenant_id string, id string")
    nodes, edges = graph.reachable(df, starts, depth, direction, by_start=True)
    got_nodes, got_edges = {tuple(r[1:]) for r in nodes.collect()}, {tuple(r[1:]) for r in edges.collect()}
    want = {s: trails(own, s, depth or 99, direction) for s in "ac"}
    assert got_nodes == {(s, n, h) for s, (ns, _) in want.items() for n, h in ns.items()}
    assert got_edges == {(s, e, h) for s, (_, es) in want.items() for e, h in es.items()}
    together, all_edges = graph.reachable(df, starts, depth, direction)
    assert {r.id for r in together.collect()} == {n for _, n, _ in got_nodes} and {r.id for r in all_edges.collect()} == {e for _, e, _ in got_edges}


def test_dense_graph_is_left_once(spark):
    """Paths here are too many to list: every node of ten layers leads to every one of the next."""
    n = 12
    rows = [("t", f"{k}.{i}>{j}", "L", f"{k}.{i}", f"{(k + 1) % 10}.{j}", D[0], None) for k in range(10) for i in range(n) for j in range(n)]
    nodes, edges = graph.reachable(spark.createDataFrame(rows, EDGE), spark.createDataFrame([("t", "0.0")], "tenant_id string, id string"))
    assert nodes.count() == 10 * n and edges.count() == len(rows) and nodes.agg({"hops": "max"}).first()[0] == 10


def test_reachable_at_a_moment(spark):
    df = spark.createDataFrame([("t", "1", "A", "a", "b", D[0], D[3]), ("t", "2", "A", "b", "c", D[2], None), ("t", "3", "B", "a", "d", D[0], None)], EDGE)
    nodes = spark.createDataFrame([("t", x, "N", D[0], D[4] if x == "d" else None, {}) for x in "abcd"], NODE)
    start = spark.createDataFrame([("t", "a")], "tenant_id string, id string")
    ids = lambda **k: {r.id for r in graph.reachable(df, start, **k)[0].collect()}
    assert ids(moment=D[2]) == {"a", "b", "c", "d"} and ids(moment=D[1]) == {"a", "b", "d"} and ids(moment=D[5]) == {"a", "d"}
    assert ids(moment=D[5], nodes=nodes) == set() and ids(moment=D[2], nodes=nodes, labels=["B"]) == {"a", "d"}
    with pytest.raises(ValueError):
        graph.reachable(df, start, 0)


def test_questions_only_read_the_tenant(spark, tmp_path):
    facts = spark.createDataFrame([("t", "1", "A", "a", "b", D[0], None), ("u", "2", "A", "b", "c", D[0], None)], EDGE)
    nodes = spark.createDataFrame([("t", "a", "N", D[0], None, {}), ("u", "b", "N", D[0], None, {})], NODE)
    facts.write.parquet(str(tmp_path / "secret"))
    facts.createOrReplaceTempView("hidden")
    ask = lambda q, p=None: [tuple(r) for r in graph.answered(nodes, facts, "t", q, p).collect()]
    assert ask("SELECT id FROM {edges} -- all of them") == [("1",)]
    assert ask("WITH t AS (SELECT * FROM {nodes}), s AS (SELECT id FROM t) SELECT s.id, (SELECT count(*) FROM {edges}) FROM s WHERE s.id = :x", {"x": "a"}) == [("a", 1)]
    refused = (
        f"SELECT count(*) FROM parquet.`{tmp_path}/secret`", f"WITH t AS (SELECT 1 AS a) INSERT OVERWRITE DIRECTORY '{tmp_path}/out' USING parquet SELECT * FROM t", "DROP VIEW hidden",
        "SELECT * FROM hidden", "SELECT id FROM {nodes} WHERE id IN (SELECT id FROM hidden)", "SELECT * FROM {edges} JOIN global_temp.x USING (id)", "CREATE TABLE x AS SELECT 1", "TABLE hidden",
        "SELECT * FROM (WITH hidden AS (SELECT 1 AS id) SELECT * FROM hidden) CROSS JOIN hidden", "SELECT * FROM IDENTIFIER('hidden')", "SELECT reflect('java.lang.System', 'getenv', 'HOME')",
        "SELECT `Java_Method`('java.lang.System', 'gc')", "SELECT 1) AS a, (SELECT * FROM hidden", "WITH x AS (SELECT * FROM hidden) SELECT * FROM x", "FROM hidden", "SELECT 1; SELECT 2", "SELECT * FROM nodes",
    )
    for q in refused:
        with pytest.raises(ValueError):
            ask(q)
    assert not (tmp_path / "out").exists() and spark.catalog.tableExists("hidden")
    spark.catalog.dropTempView("hidden")


def test_steps_are_written_once(spark, monkeypatch):
    """Only the steps and the nodes found are written, not what each round steps over."""
    written = []
    keep = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: written.append(out := keep(df)) or out)
    rows = [("t", f"{k}.{i}>{j}", "L", f"{k}.{i}", f"{(k + 1) % 4}.{j}", D[0], None) for k in range(4) for i in range(9) for j in range(9)]
    nodes, edges = graph.reachable(spark.createDataFrame(rows, EDGE), spark.createDataFrame([("t", "0.0")], "tenant_id string, id string"))
    assert nodes.count() == 36 and edges.count() == len(rows) and sum(df.count() for df in written) == len(rows) + 36
