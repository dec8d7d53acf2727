"""Queries over the temporal graph, the tables and message streams."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from cartulary.functions import ids
from cartulary.operators import graph as G
from cartulary.operators import tables as T
from cartulary.operators.stored import shared_dir
from cartulary.plans import inputs as I
from cartulary.streaming import bus as B
from cartulary.streaming.graph_sink import EdgeStore

DAY = datetime(1995, 6, 17)


def graph_current(spark, sf):
    return G.relationships(I.edges(spark, sf), I.nodes(spark, sf), "acme").select("id", "source_id", "target_id", F.col("source_props")["segment"].alias("segment"))


def graph_asof(spark, sf):
    return G.relationships(I.edges(spark, sf), I.nodes(spark, sf), "acme", labels=["F", "O"], moment=DAY).select("id", "source_id", "target_id")


def graph_by_property(spark, sf):
    return G.relationships(I.edges(spark, sf), I.nodes(spark, sf), "acme", props={"status": "P"}, moment=DAY).select("id", "source_id", "target_id")


def graph_supersede(spark, sf):
    closed, _ = G.supersede(I.edges(spark, sf), "acme", "1", DAY)
    return closed.where("id = '1' or valid_to is null").select("id", "valid_to")


def _roots(spark):
    return spark.createDataFrame([("acme", f"r{i}") for i in range(5)], "tenant_id string, id string")


def graph_traverse_out(spark, sf):
    p = G.traverse(I.places(spark, sf), _roots(spark), 2)
    return p.select("start_id", "end_id", F.col("hops").cast("long").alias("hops"))


def graph_traverse_in(spark, sf):
    start = I.table(spark, sf, "supplier").select(F.lit("acme").alias("tenant_id"), F.concat(F.lit("s"), "s_suppkey").alias("id"))
    p = G.traverse(I.places(spark, sf), start, 2, "inbound")
    return p.select("start_id", "end_id", F.col("hops").cast("long").alias("hops"))


def graph_traverse_both(spark, sf):
    """What is two steps from a nation in either direction."""
    nations = I.table(spark, sf, "nation").select(F.lit("acme").alias("tenant_id"), F.concat(F.lit("n"), "n_nationkey").alias("id"))
    p = G.traverse(I.places(spark, sf), nations, 2, "both").where("hops = 2")
    return p.select("start_id", "end_id")


def graph_traverse_deep(spark, sf):
    """All that regions lead to, however far."""
    p = G.traverse(I.places(spark, sf), _roots(spark), None)
    return p.select("start_id", "end_id", F.col("hops").cast("long").alias("hops"))


def graph_path_asof(spark, sf):
    """Paths of two steps that held on a day: from a nation to its customers, and on to the priorities of their orders."""
    c = I.table(spark, sf, "customer")
    lives = c.select(
        F.lit("acme").alias("tenant_id"), F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("LIVES_IN").alias("label"), F.concat(F.lit("n"), "c_nationkey").alias("source_id"),
        F.col("c_custkey").cast("string").alias("target_id"), F.lit(datetime(1990, 1, 1)).alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"),
    )
    e = I.edges(spark, sf).drop("props").unionByName(lives)
    start = lives.select("tenant_id", F.col("source_id").alias("id")).distinct()
    p = G.traverse(e, start, 2, moment=DAY).where("hops = 2")
    return p.groupBy("start_id", "end_id").agg(F.count("*").alias("n"))


def graph_node(spark, sf):
    return G.node(I.nodes(spark, sf), "acme", "1", "Customer").select("id", "label", F.col("props")["segment"].alias("segment"))


def graph_edge(spark, sf):
    return G.edge(I.edges(spark, sf), "acme", "1").select("id", "label", "source_id", "target_id")


def graph_query(spark, sf):
    """A question in SQL over the facts of a day, with a parameter."""
    q = "SELECT target_id AS priority, count(*) AS n FROM {edges} WHERE label = :label GROUP BY target_id"
    return G.answered(I.nodes(spark, sf), I.edges(spark, sf), "acme", q, {"label": "O"}, DAY)


def _new_nodes(spark, sf):
    n = I.table(spark, sf, "nation")
    return n.select(F.lit("acme").alias("tenant_id"), F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("Nation").alias("label"), F.lit(DAY).alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.create_map(F.lit("name"), F.col("n_name")).alias("props"))


def graph_add_nodes(spark, sf):
    return G.add_nodes(I.nodes(spark, sf), _new_nodes(spark, sf)).groupBy("label").agg(F.count("*").alias("n"))


def graph_add_edges(spark, sf):
    """Only edges whose ends exist are added: customers to their nations."""
    nodes = I.nodes(spark, sf).unionByName(_new_nodes(spark, sf))
    c = I.table(spark, sf, "customer")
    new = c.select(F.lit("acme").alias("tenant_id"), F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("LIVES_IN").alias("label"), F.col("c_custkey").cast("string").alias("source_id"), F.concat(F.lit("n"), (F.col("c_nationkey") * 2).cast("string")).alias("target_id"), F.lit(DAY).alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.create_map(F.lit("status"), F.lit("L")).alias("props"))
    return G.add_edges(I.edges(spark, sf), nodes, new).groupBy("label").agg(F.count("*").alias("n"))


def page_with_total(spark, sf):
    """A page, the number of all rows, and where the next page begins."""
    rows, total, following = T.paged(I.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate").desc(), "o_orderkey"], 20, 40)
    return rows.select("o_orderkey", F.lit(total).cast("long").alias("total"), F.lit(following).cast("long").alias("next_offset"))


def _supply(spark, sf):
    """A graph with cycles and hubs: parts lead to their suppliers, those to nations and regions, and those back to parts."""
    edge = lambda df, a, b: df.select(
        F.lit("acme").alias("tenant_id"), F.concat_ws(">", a, b).alias("id"), F.lit("LEADS_TO").alias("label"), a.alias("source_id"), b.alias("target_id"),
        F.lit(datetime(1990, 1, 1)).alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"),
    )
    name = lambda kind, column: F.concat(F.lit(kind), F.col(column))
    made = edge(I.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct(), name("p", "l_partkey"), name("s", "l_suppkey"))
    back = I.table(spark, sf, "part").where("p_partkey % 7 <> 0").withColumn("r", F.col("p_partkey") % 5)
    for part in (edge(I.table(spark, sf, "supplier"), name("s", "s_suppkey"), name("n", "s_nationkey")), edge(I.table(spark, sf, "nation"), name("n", "n_nationkey"), name("r", "n_regionkey")), edge(back, name("r", "r"), name("p", "p_partkey"))):
        made = made.unionByName(part)
    return made


def graph_reached(spark, sf):
    """What is reached from each region, however far, and at how many steps."""
    nodes, _ = G.reachable(_supply(spark, sf), _roots(spark), by_start=True)
    return nodes.select("start_id", "id", F.col("hops").cast("long").alias("hops"))


def graph_reached_edges(spark, sf):
    """The edges within three steps of any supplier, in either direction, and the step that first takes them."""
    start = I.table(spark, sf, "supplier").where("s_suppkey % 10 = 0").select(F.lit("acme").alias("tenant_id"), F.concat(F.lit("s"), "s_suppkey").alias("id"))
    _, edges = G.reachable(_supply(spark, sf), start, 3, "both")
    return edges.select("id", F.col("hops").cast("long").alias("hops"))


def graph_degree(spark, sf):
    e = I.edges(spark, sf).where(G.at(DAY))
    return e.groupBy("target_id").agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("sources"))


def _dealt(df, *by):
    """Rows brought together by number before they are counted: hardly two are the same, so counting what a file's split
    holds first would keep the whole split in memory, and Spark would give a task as many rows as their few bytes allow."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _consensus(spark, sf):
    key = ["source_id", "target_id", "relationship"]
    p = _dealt(I.pairs(spark, sf).where("relationship <> 'NO_RELATIONSHIP'").select(*key), *key).dropDuplicates(key)
    return p.select(F.lit("acme").alias("tenant_id"), F.lit("j1").alias("job_id"), "source_id", "target_id", "relationship", (F.col("target_id").cast("int") % 10 / 10).alias("confidence"))


def mat_relationship_edges(spark, sf):
    e = G.relationship_edges(_consensus(spark, sf), F.lit(DAY))
    e = _dealt(e.select(F.col("props")["relationship"].alias("relationship"), "id"), "relationship", "id")
    return e.groupBy("relationship").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


def mat_requires_edges(spark, sf):
    v = I.votes(spark, sf).select(F.lit("acme").alias("tenant_id"), F.lit("j1").alias("job_id"), F.col("pair_id").alias("source_id"), F.col("vote_key").alias("target_id"), "decision", F.lit(0.9).alias("confidence"), F.lit(DAY).alias("analyzed_at"))
    return G.requires_edges(v).select("source_id", "target_id", "label", "valid_from")


def mat_merge(spark, sf):
    """Materialising twice adds nothing."""
    e = G.relationship_edges(_consensus(spark, sf), F.lit(DAY))
    return G.merged_edges(e.dropDuplicates(["tenant_id", "id"]), e).agg(F.count("*").alias("n"))


def mat_mappings(spark, sf):
    e = G.relationship_edges(_consensus(spark, sf), F.lit(DAY))
    return G.mappings(e, "acme", "1", 0.4).select("source_id", "target_id", "confidence")


def _controls(spark, sf):
    c = I.table(spark, sf, "customer")
    return c.select(F.lit("acme").alias("tenant_id"), F.concat(F.lit("c"), "c_custkey").alias("control_id"), F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("n"), "c_nationkey")).alias("parent_id"))


def catalog_parent_edges(spark, sf):
    _, edges = G.catalog_facts(_controls(spark, sf), F.lit(DAY))
    return edges.select("source_id", "target_id", "label")


def catalog_counts(spark, sf):
    catalogs = I.table(spark, sf, "nation").select(F.col("n_nationkey").alias("catalog_id"), F.col("n_name").alias("title"))
    controls = I.table(spark, sf, "customer").select(F.col("c_nationkey").alias("catalog_id"))
    return T.with_control_counts(catalogs, controls).select("catalog_id", "title", "control_count")


def catalog_list_page(spark, sf):
    o = I.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return T.page(o, [F.col("o_orderdate").desc(), "o_orderkey"], 20, 40)


def list_filters(spark, sf):
    o = T.filtered(I.table(spark, sf, "orders"), [("o_orderstatus", "eq", "F"), ("o_totalprice", "gt", 100000.0), ("o_orderpriority", "in", ["1-URGENT", "2-HIGH"]), ("o_orderpriority", "contains", "-"), ("o_custkey", "lt", None)])
    return o.select("o_orderkey", "o_custkey")


def _store(spark, sf):
    e = I.table(spark, sf, "embeddings")
    return e.select((F.col("label") % 3).cast("long").alias("catalog_id"), F.col("vec_id").alias("control_id"), F.lit("m1").alias("model"), F.size("embedding").cast("long").alias("dim"), F.lit("acme").alias("tenant_id"))


def upsert_embedding(spark, sf):
    s = _store(spark, sf)
    new = s.where("control_id % 10 = 0").withColumn("dim", F.col("dim") + 1).unionByName(s.where("control_id % 100 = 1").withColumn("model", F.lit("m2")))
    return T.upserted(s, new, ["tenant_id", "catalog_id", "control_id", "model"]).groupBy("model", "dim").agg(F.count("*").alias("n"))


def delete_by_model(spark, sf):
    s = _store(spark, sf).withColumn("model", F.expr("CASE WHEN control_id % 4 = 0 THEN 'old' ELSE 'm1' END"))
    return T.deleted(s, F.col("model") == "old").groupBy("catalog_id").agg(F.count("*").alias("n"))


def _stages(spark, sf):
    stages = F.array(*map(F.lit, ("classify", "embedding", "relationship", "synthesis", "graph")))
    o = I.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("job_id"), F.explode(stages).alias("stage"))
    return o.select("job_id", "stage", F.lit("completed").alias("status"), F.lit(DAY).alias("started_at"), F.lit(DAY).alias("completed_at"), F.lit(0).alias("retry_count"))


def reset_stages(spark, sf):
    order = ["classify", "embedding", "relationship", "synthesis", "graph"]
    r = T.reset_from(_stages(spark, sf), "50", "relationship", order)
    return r.select("job_id", "stage", "status", "retry_count", F.col("started_at").isNull().alias("cleared"))


def job_stamp(spark, sf):
    jobs = I.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("job_id"), F.lit("pending").alias("status"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"))
    return T.stamped(T.stamped(jobs, "1", "running", F.lit(DAY)), "2", "failed", F.lit(DAY))


def tally_results(spark, sf):
    e = I.table(spark, sf, "events").select(F.col("event_type").alias("analyzer"), F.expr("CASE WHEN event_id % 9 = 0 THEN 'boom' END").alias("error"), F.expr("CASE WHEN event_id % 13 <> 0 THEN 'x' END").alias("result"), F.expr("CASE WHEN event_id % 5 = 0 THEN 'true' END").alias("skipped"))
    return T.tally(e)


def duplicate_ids(spark, sf):
    items = I.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), F.col("l_linenumber").cast("string").alias("parent_id"))
    return T.duplicates(items)


def manifest(spark, sf):
    n = I.table(spark, sf, "nation")
    return T.manifest(n.select(ids.content_hash(F.col("n_name")).alias("digest"), F.col("n_name").alias("uri")))


def content_ids(spark, sf):
    p = I.table(spark, sf, "part")
    digest = ids.content_hash(F.col("p_name"))
    return p.select("p_partkey", digest.alias("digest"), ids.catalog_id(digest, F.lit("acme")).alias("catalog_id"), ids.control_id(F.lit("cat"), F.col("p_brand")).alias("control_id"), ids.artifact_id(F.lit("c1"), F.col("p_name"), F.lit("POLICY")).alias("artifact_id"))


def _messages(spark, sf):
    c = I.table(spark, sf, "conversations")
    m = c.select(F.concat(F.lit("cartulary.work.acme."), "role").alias("subject"), F.coalesce("text", F.lit("")).alias("data"), F.lit("acme").alias("tenant_id"), F.col("conv_id").cast("string").alias("job_id"), F.create_map(F.lit("tenant_id"), F.lit("other"), F.lit("turn"), F.col("turn").cast("string")).alias("headers"))
    return B.published(m, "loader", F.lit(DAY))


def stream_verify_hash(spark, sf):
    """One message in five is altered after it was published."""
    m = _messages(spark, sf).withColumn("data", F.when(F.col("headers")["turn"].cast("long") % 5 == 2, F.concat("data", F.lit("!"))).otherwise(F.col("data")))
    return B.verified(m).groupBy(B.tenant_of(F.col("subject")).alias("tenant"), F.col("headers")["tenant_id"].alias("header")).agg(F.count("*").alias("n"))


def stream_subjects(spark, sf):
    m = _messages(spark, sf)
    return m.where(B.matches(F.col("subject"), "cartulary.*.acme.user")).agg(F.count("*").alias("n"))


def retention_filter(spark, sf):
    e = I.table(spark, sf, "events").select("event_id", "ts", F.expr("CASE event_id % 3 WHEN 0 THEN 'llm' WHEN 1 THEN 'events' ELSE 'decisions' END").alias("stream"))
    now = F.lit(datetime(2024, 3, 1))
    return B.retained(e, now).groupBy("stream").agg(F.count("*").alias("n"))


def fan_out(spark, sf):
    p = I.pairs(spark, sf).select(F.lit("j1").alias("job_id"), "source_id", "target_id")
    t = B.tasks(p, ["m1", "m2"], 3)
    return t.groupBy("model", F.col("sample").cast("long").alias("sample")).agg(F.count("*").alias("n"))


def collect_results(spark, sf):
    o = I.table(spark, sf, "orders")
    expected = o.select(F.lit("j1").alias("job_id"), F.col("o_orderkey").cast("string").alias("task_id"))
    results = I.table(spark, sf, "lineitem").select(F.lit("j1").alias("job_id"), (F.col("l_orderkey") + 1).cast("string").alias("task_id"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").cast("string").alias("payload"), F.expr("CASE WHEN l_linenumber % 2 = 1 THEN 'error' END").alias("error"))
    return B.collected(expected, results, 2).groupBy("state").agg(F.count("*").alias("n"), F.sum("errors").alias("errors"))


def graph_events(spark, sf):
    """Ended stages from messages in three batches, one of them seen twice, taken into a store of edges."""
    o = I.table(spark, sf, "orders")
    tenant = F.concat(F.lit("t"), (F.col("o_orderkey") % 3).cast("string"))
    job, analyzer = (F.col("o_orderkey") % 40).cast("string"), F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'requires' WHEN 1 THEN 'classify' ELSE 'relationship' END")
    ended = o.select(
        F.concat(F.lit("app.pipeline."), tenant, F.lit("."), job, F.expr("CASE WHEN o_orderkey % 11 = 0 THEN '.stage.started' ELSE '.stage.completed' END")).alias("subject"),
        F.expr("CASE WHEN o_orderkey % 13 = 0 THEN 'no json' END").alias("broken"), F.to_json(F.struct(job.alias("job_id"), analyzer.alias("analyzer"))).alias("told"), (F.col("o_orderkey") % 4).alias("part"),
    ).select("subject", F.coalesce("broken", "told").alias("data"), "part")
    li = I.table(spark, sf, "lineitem")
    results = li.select(
        F.concat(F.lit("t"), (F.col("l_suppkey") % 3).cast("string")).alias("tenant_id"), (F.col("l_orderkey") % 40).cast("string").alias("job_id"),
        F.expr("CASE WHEN l_linestatus = 'O' THEN 'requires' ELSE 'relationship' END").alias("analyzer"), F.col("l_suppkey").cast("string").alias("source_id"), F.col("l_partkey").cast("string").alias("target_id"),
        F.expr("CASE WHEN l_linestatus = 'O' AND l_partkey % 2 = 0 THEN 'REQUIRES' ELSE 'PARTIAL' END").alias("relationship"), F.lit(0.5).alias("confidence"), F.lit(DAY).alias("analyzed_at"),
    )
    store = EdgeStore(spark, f"{shared_dir(spark)}/events-{uuid.uuid4().hex}")
    for batch_id, parts in enumerate(([0, 1], [1, 2], [3])):
        store.take(ended.where(F.col("part").isin(parts)), results, "stages", batch_id)
    store.take(ended, results, "stages", 1)  # seen again: the log has it
    return store.edges().groupBy("tenant_id", "label").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


QUERIES = {
    f.__name__: f
    for f in (
        graph_current, graph_asof, graph_by_property, graph_supersede, graph_traverse_out, graph_traverse_in, graph_traverse_both, graph_traverse_deep, graph_path_asof, graph_node, graph_edge, graph_query, graph_add_nodes, graph_add_edges, page_with_total, graph_reached, graph_reached_edges, graph_degree, mat_relationship_edges,
        mat_requires_edges, mat_merge, mat_mappings, catalog_parent_edges, catalog_counts, catalog_list_page, list_filters, upsert_embedding, delete_by_model, reset_stages,
        job_stamp, tally_results, duplicate_ids, manifest, content_ids, stream_verify_hash, stream_subjects, retention_filter, fan_out, collect_results, graph_events,
    )
}

_AT = "valid_from <= TIMESTAMP '1995-06-17' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1995-06-17')"
_E = f"e AS ({I.EDGES_SQL})"
_P = f"p AS ({I.PLACES_SQL})"
_SUPPLY = (
    "g AS (SELECT DISTINCT 'p'||l_partkey AS a, 's'||l_suppkey AS b FROM lineitem UNION ALL SELECT 's'||s_suppkey, 'n'||s_nationkey FROM supplier UNION ALL "
    "SELECT 'n'||n_nationkey, 'r'||n_regionkey FROM nation UNION ALL SELECT 'r'||(p_partkey%5), 'p'||p_partkey FROM part WHERE p_partkey%7<>0)"
)
_CONS = f"c AS (SELECT DISTINCT source_id, target_id, relationship FROM ({I.PAIRS_SQL}) WHERE relationship <> 'NO_RELATIONSHIP')"
ORACLE = {
    "graph_current": f"WITH {_E} SELECT id, source_id, target_id, c_mktsegment AS segment FROM e JOIN customer ON CAST(c_custkey AS VARCHAR)=source_id WHERE valid_to IS NULL",
    "graph_asof": f"WITH {_E} SELECT id, source_id, target_id FROM e WHERE label IN ('F','O') AND {_AT} AND source_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)",
    "graph_by_property": f"WITH {_E} SELECT id, source_id, target_id FROM e WHERE label='P' AND {_AT} AND source_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)",
    "graph_supersede": f"WITH {_E} SELECT id, CASE WHEN id='1' AND valid_to IS NULL THEN TIMESTAMP '1995-06-17' ELSE valid_to END AS valid_to FROM e WHERE id='1' OR valid_to IS NULL",
    "graph_traverse_out": f"WITH RECURSIVE {_P}, r AS (SELECT source_id AS start_id, target_id AS end_id, 1 AS hops FROM p WHERE source_id LIKE 'r%' UNION ALL SELECT r.start_id, p.target_id, hops+1 FROM r JOIN p ON p.source_id=r.end_id WHERE hops<2) SELECT start_id, end_id, hops::BIGINT AS hops FROM r",
    "graph_traverse_in": f"WITH RECURSIVE {_P}, r AS (SELECT target_id AS start_id, source_id AS end_id, 1 AS hops FROM p WHERE target_id LIKE 's%' UNION ALL SELECT r.start_id, p.source_id, hops+1 FROM r JOIN p ON p.target_id=r.end_id WHERE hops<2) SELECT start_id, end_id, hops::BIGINT AS hops FROM r",
    "graph_traverse_both": f"WITH {_P}, u AS (SELECT source_id AS a, target_id AS b, source_id||'>'||target_id AS e FROM p UNION ALL SELECT target_id, source_id, source_id||'>'||target_id FROM p) SELECT x.a AS start_id, y.b AS end_id FROM u x JOIN u y ON x.b=y.a AND x.e<>y.e WHERE x.a LIKE 'n%'",
    "graph_reached": f"WITH RECURSIVE {_SUPPLY}, r AS (SELECT 'r'||i AS start_id, 'r'||i AS id, 0 AS hops FROM range(5) t(i) WHERE 'r'||i IN (SELECT a FROM g) UNION SELECT start_id, b, hops+1 FROM r JOIN g ON a=r.id WHERE hops<12) SELECT start_id, id, min(hops)::BIGINT AS hops FROM r GROUP BY ALL",
    "graph_reached_edges": f"WITH RECURSIVE {_SUPPLY}, u AS (SELECT a, b, a||'>'||b AS e FROM g UNION ALL SELECT b, a, a||'>'||b FROM g), r AS (SELECT 's'||s_suppkey AS id, 0 AS hops FROM supplier WHERE s_suppkey%10=0 UNION SELECT b, hops+1 FROM r JOIN u ON a=r.id WHERE hops<2) SELECT e AS id, (min(hops)+1)::BIGINT AS hops FROM r JOIN u ON a=r.id GROUP BY e",
    "graph_traverse_deep": f"WITH RECURSIVE {_P}, r AS (SELECT source_id AS start_id, target_id AS end_id, 1 AS hops FROM p WHERE source_id LIKE 'r%' UNION ALL SELECT r.start_id, p.target_id, hops+1 FROM r JOIN p ON p.source_id=r.end_id) SELECT start_id, end_id, hops::BIGINT AS hops FROM r",
    "graph_path_asof": f"WITH {_E} SELECT 'n'||c_nationkey AS start_id, target_id AS end_id, count(*) AS n FROM e JOIN customer ON source_id=c_custkey::VARCHAR WHERE {_AT} GROUP BY ALL",
    "graph_node": "SELECT '1' AS id, 'Customer' AS label, c_mktsegment AS segment FROM customer WHERE c_custkey=1",
    "graph_edge": f"WITH {_E} SELECT id, label, source_id, target_id FROM e WHERE id='1'",
    "graph_query": f"WITH {_E} SELECT target_id AS priority, count(*) AS n FROM e WHERE label='O' AND {_AT} GROUP BY target_id",
    "graph_add_nodes": "SELECT 'Customer' AS label, count(*) AS n FROM customer UNION ALL SELECT 'Priority', count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'Nation', count(*) FROM nation",
    "graph_add_edges": f"WITH {_E} SELECT label, count(*) AS n FROM e GROUP BY label UNION ALL SELECT 'LIVES_IN', count(*) FROM customer WHERE c_nationkey*2 IN (SELECT n_nationkey FROM nation)",
    "page_with_total": "SELECT o_orderkey, (SELECT count(*) FROM orders) AS total, CASE WHEN (SELECT count(*) FROM orders) > 60 THEN 60 END::BIGINT AS next_offset FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40",
    "graph_degree": f"WITH {_E} SELECT target_id, count(*) AS n, count(DISTINCT source_id) AS sources FROM e WHERE {_AT} GROUP BY target_id",
    "mat_relationship_edges": f"WITH {_CONS}, d AS (SELECT relationship, count(*) AS n, count(DISTINCT (source_id, target_id)) AS ids FROM c GROUP BY relationship) SELECT * FROM d",
    "mat_requires_edges": f"SELECT pair_id AS source_id, vote_key AS target_id, 'REQUIRES' AS label, TIMESTAMP '1995-06-17' AS valid_from FROM ({I.VOTES_SQL}) WHERE decision",
    "mat_merge": f"WITH {_CONS} SELECT count(DISTINCT (source_id, target_id)) AS n FROM c",
    "mat_mappings": f"WITH {_CONS} SELECT source_id, target_id, (target_id::INTEGER%10)/10::DOUBLE AS confidence FROM c WHERE source_id='1' AND target_id::INTEGER%10>=4",
    "catalog_parent_edges": "SELECT 'n'||c_nationkey AS source_id, 'c'||c_custkey AS target_id, 'PARENT_OF' AS label FROM customer WHERE c_custkey % 3 <> 0",
    "catalog_counts": "SELECT n_nationkey AS catalog_id, n_name AS title, (SELECT count(*) FROM customer WHERE c_nationkey=n_nationkey) AS control_count FROM nation",
    "catalog_list_page": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40",
    "list_filters": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus='F' AND o_totalprice>100000 AND o_orderpriority IN ('1-URGENT','2-HIGH') AND contains(o_orderpriority,'-')",
    "upsert_embedding": "SELECT model, dim, count(*) AS n FROM (SELECT 'm1' AS model, len(embedding)::BIGINT + CASE WHEN vec_id%10=0 THEN 1 ELSE 0 END AS dim FROM embeddings UNION ALL SELECT 'm2', len(embedding)::BIGINT FROM embeddings WHERE vec_id%100=1) GROUP BY ALL",
    "delete_by_model": "SELECT (label%3)::BIGINT AS catalog_id, count(*) AS n FROM embeddings WHERE vec_id%4<>0 GROUP BY 1",
    "reset_stages": "SELECT o_orderkey::VARCHAR AS job_id, stage, CASE WHEN o_orderkey=50 AND pos>2 THEN 'pending' ELSE 'completed' END AS status, CASE WHEN o_orderkey=50 AND pos>2 THEN 1 ELSE 0 END AS retry_count, (o_orderkey=50 AND pos>2) AS cleared FROM orders, (VALUES (1,'classify'),(2,'embedding'),(3,'relationship'),(4,'synthesis'),(5,'graph')) s(pos,stage)",
    "job_stamp": "SELECT o_orderkey::VARCHAR AS job_id, CASE o_orderkey WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN o_orderkey=1 THEN TIMESTAMP '1995-06-17' END AS started_at, CASE WHEN o_orderkey=2 THEN TIMESTAMP '1995-06-17' END AS completed_at FROM orders",
    "tally_results": "SELECT event_type AS analyzer, count_if(event_id%9<>0 AND event_id%13<>0 AND event_id%5<>0)::BIGINT AS processed, count_if(event_id%9<>0 AND event_id%13<>0 AND event_id%5=0)::BIGINT AS skipped, count_if(event_id%9=0 OR event_id%13=0)::BIGINT AS errors, count_if(event_id%9=0 OR event_id%13=0)>0 AS incomplete, count_if(event_id%9<>0 AND event_id%13<>0)=0 AS failed FROM events GROUP BY event_type",
    "duplicate_ids": "SELECT l_orderkey::VARCHAR AS id, 'duplicate' AS problem FROM lineitem GROUP BY l_orderkey HAVING count(*)>1 UNION ALL SELECT l_orderkey::VARCHAR, 'own parent' FROM lineitem WHERE l_orderkey=l_linenumber",
    "manifest": "SELECT string_agg(sha256(n_name)||'  '||n_name, chr(10) ORDER BY n_name)||chr(10) AS manifest FROM nation",
    "content_ids": "SELECT p_partkey, sha256(p_name) AS digest, substr(sha256(sha256(p_name)||'acme'),1,16) AS catalog_id, 'cat/'||p_brand AS control_id, 'c1__art_'||substr(sha256(p_name||':POLICY'),1,8) AS artifact_id FROM part",
    "stream_verify_hash": "SELECT 'acme' AS tenant, 'acme' AS header, count(*) AS n FROM conversations WHERE turn % 5 <> 2",
    "stream_subjects": "SELECT count(*) AS n FROM conversations WHERE role='user'",
    "retention_filter": "SELECT stream, count(*) AS n FROM (SELECT ts, CASE event_id%3 WHEN 0 THEN 'llm' WHEN 1 THEN 'events' ELSE 'decisions' END AS stream FROM events) WHERE stream='decisions' OR (stream='llm' AND ts >= TIMESTAMP '2024-03-01' - INTERVAL 90 DAY) OR (stream='events' AND ts >= TIMESTAMP '2024-03-01' - INTERVAL 30 DAY) GROUP BY stream",
    "fan_out": f"SELECT model, sample::BIGINT AS sample, count(*) AS n FROM ({I.PAIRS_SQL}), (VALUES ('m1'),('m2')) m(model), (VALUES (1),(2),(3)) s(sample) GROUP BY ALL",
    "collect_results": "WITH f AS (SELECT *, min(CASE WHEN l_linenumber%2=0 THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS first FROM lineitem), r AS (SELECT (l_orderkey+1)::VARCHAR AS task_id, count_if(l_linenumber%2=1) AS errors, count_if(l_linenumber%2=0) AS good, count_if(l_linenumber%2=1 AND (first IS NULL OR l_linenumber<first)) AS before FROM f GROUP BY 1) SELECT CASE WHEN before>2 THEN 'failed' WHEN good>0 THEN 'done' ELSE 'pending' END AS state, count(*) AS n, sum(coalesce(errors,0))::BIGINT AS errors FROM orders LEFT JOIN r ON task_id=o_orderkey::VARCHAR GROUP BY 1",
    "graph_events": """WITH m AS (SELECT DISTINCT 't'||(o_orderkey%3) AS tenant_id, (o_orderkey%40)::VARCHAR AS job_id, CASE o_orderkey%5 WHEN 0 THEN 'requires' WHEN 1 THEN 'classify' ELSE 'relationship' END AS analyzer FROM orders WHERE o_orderkey%11<>0 AND o_orderkey%13<>0),
      r AS (SELECT 't'||(l_suppkey%3) AS tenant_id, (l_orderkey%40)::VARCHAR AS job_id, CASE WHEN l_linestatus='O' THEN 'requires' ELSE 'relationship' END AS analyzer, l_suppkey, l_partkey FROM lineitem),
      e AS (SELECT DISTINCT tenant_id, job_id, CASE analyzer WHEN 'requires' THEN 'REQUIRES' ELSE 'SEMANTIC_MATCH' END AS label, l_suppkey, l_partkey FROM r SEMI JOIN m USING (tenant_id, job_id, analyzer) WHERE analyzer='relationship' OR l_partkey%2=0)
      SELECT tenant_id, label, count(*) AS n, count(*) AS ids FROM e GROUP BY ALL""",
}
