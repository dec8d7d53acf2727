"""Queries over stores, registries and the rules that guard them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from cartulary.operators import candidates as C
from cartulary.operators import dag
from cartulary.operators import graph as G
from cartulary.operators import similarity as S
from cartulary.operators import structure as Q
from cartulary.operators import synthesis as Y
from cartulary.operators import tables as T
from cartulary.plans import inputs as I

DAY = datetime(1995, 6, 17)


def cand_semantic(spark, sf):
    """The three nearest targets of each source, by similarities of 20 or more."""
    e = I.table(spark, sf, "embeddings").select(F.col("vec_id").alias("control_id"), F.col("embedding").alias("vector"))
    found = C.SemanticVectors(e, 3, 20.0).generate(e, e)
    return found.select("source_id", "target_id", F.round("score", 4).alias("score"), "generator")


def cand_registry(spark, sf):
    """Two generators by name, united: every pair by level or by word once."""
    word, level = F.expr("CASE WHEN p_size % 3 = 0 THEN 'policy ' ELSE '' END"), F.expr("CASE p_size % 4 WHEN 0 THEN 'Strategic' WHEN 1 THEN 'Tactical' ELSE 'unknown' END")
    d = I.table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("control_id"), F.concat(word, F.col("p_name")).alias("text"), level.alias("level"))
    s = I.table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("control_id"), "s_name", F.expr("CASE s_nationkey % 3 WHEN 0 THEN 'Tactical' WHEN 1 THEN 'Operational' ELSE '' END").alias("level"))
    r = C.Registry()
    r.register(C.Level())
    r.register(C.Keyword())
    return r.classes(s, d, "union").counted("source", "generator")


def scoped_rows(spark, sf):
    d = I.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("tenant-"), F.coalesce("lang", F.lit("none"))).alias("tenant_id"), F.when(F.col("source") == "src0", F.lit(None)).otherwise(F.col("source")).alias("user_id"))
    return T.scoped(d, "tenant-en", "src1").select("doc_id")


def validated_inputs(spark, sf):
    return Y.validated(I.pairs(spark, sf)).groupBy("relationship").agg(F.count("*").alias("n"))


def broken_links(spark, sf):
    """Parts that the second step used with another digest than the first made."""
    p = I.table(spark, sf, "part")
    steps = spark.createDataFrame([("build",), ("test",)], "step string")
    made = p.select(F.lit("build").alias("step"), F.col("p_partkey").cast("string").alias("uri"), F.col("p_size").cast("string").alias("digest"))
    used = p.select(F.lit("test").alias("step"), F.col("p_partkey").cast("string").alias("uri"), (F.col("p_size") + F.expr("CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END")).cast("string").alias("digest"))
    return T.broken_links(steps, used, made, ["build", "test"])


def store_similar(spark, sf):
    """The ten nearest of one tenant's vectors of a catalog and model."""
    e = I.table(spark, sf, "embeddings")
    query = e.where("vec_id = 0").first()
    s = e.select(F.lit("acme").alias("tenant_id"), (F.col("label") % 3).cast("string").alias("catalog_id"), F.lit("m1").alias("model"), F.col("vec_id").alias("control_id"), F.col("embedding").alias("vector"))
    found = S.find_similar(s, "acme", "1", "m1", list(query["embedding"]) if query else [1.0], 10)
    return found.select("id", F.round("similarity", 4).alias("similarity"))


def upsert_keeps_created(spark, sf):
    """Orders written again keep the day they were first written."""
    o = I.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").alias("created_at"))
    new = o.where("o_orderstatus = 'O'").select("o_orderkey", F.lit("N").alias("o_orderstatus"), F.lit(DAY).cast(o.schema["created_at"].dataType).alias("created_at"))
    return T.upserted(o, new, ["o_orderkey"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("created_at").cast("date").alias("first"))


def write_once(spark, sf):
    row = lambda name, key: I.table(spark, sf, name).select(F.lit(name).alias("kind"), F.col(key).cast("long").alias("key"))
    running = spark.createDataFrame([("customer", "running"), ("region", "completed")], "kind string, status string")
    new = T.guarded(row("customer", "c_custkey"), running, "kind")
    return T.write_once(row("supplier", "s_suppkey"), new, ["kind", "key"]).groupBy("kind").agg(F.count("*").alias("n"))


def resumable_jobs(spark, sf):
    o = I.table(spark, sf, "orders")
    return T.resumable(o.select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "P", "running").otherwise("completed").alias("status"), F.col("o_orderdate").alias("created_at"))).select("job_id")


def artifact_facts(spark, sf):
    """Nodes and edges of agreed artifacts: one node for each control, normal name and type, and one for each type."""
    p = I.table(spark, sf, "part")
    a = p.select(F.lit("acme").alias("tenant_id"), F.col("p_brand").alias("control_id"), F.concat(F.lit("The "), "p_name").alias("name"), F.expr("CASE p_size % 3 WHEN 0 THEN 'POLICY' WHEN 1 THEN 'RECORD' ELSE 'PROCEDURE' END").alias("type"))
    nodes, edges = G.artifact_facts(a, F.lit(DAY))
    return nodes.groupBy("label").agg(F.count("*").alias("n")).union(edges.groupBy("label").agg(F.count("*").alias("n")))


def dag_outcome(spark, sf):
    """Analyzers run level by level: counts flow on, and what needs a failed one is skipped."""
    r = dag.Registry()
    r.register(dag.Analyzer("classify", lambda _: I.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")))
    r.register(dag.Analyzer("embedding", lambda x: x["classify"].groupBy("o_orderstatus").agg(F.count("*").alias("n")), ("classify",)))
    r.register(dag.Analyzer("relationship", lambda x: x["missing"], ("embedding",)))
    r.register(dag.Analyzer("requires", lambda x: x["relationship"], ("relationship",)))
    out = r.execute()
    status = spark.createDataFrame(sorted((k, v) for k, v in out.status.items()), "name string, status string")
    total = out.outputs["embedding"].agg(F.sum("n").alias("n"))
    return status.crossJoin(total)


def table_items(spark, sf):
    """Each order's line items as a table with blank cells, blank first cells, rows without text and rows without cells."""
    first = F.when(F.col("l_linenumber") % 3 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("l_linenumber").cast("string")))
    cells = F.when(F.col("l_linenumber") % 5 == 0, F.array().cast("array<string>")).when(F.col("l_linenumber") % 4 == 0, F.array(F.lit(""), F.lit(""))).otherwise(F.array(first, F.col("l_linestatus"), F.lit(" ")))
    li = I.table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", cells.alias("cells")).alias("row"))
    tables = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list("row")), lambda x: x["cells"]).alias("rows"))
    return Q.table_items(tables).select("doc_id", "id", "text")


def structurer_headings(spark, sf):
    """Headings come before numbered lines; where all are repeated too often, the lines do."""
    li = I.table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.col("l_returnflag").alias("title"), F.col("l_linestatus").alias("text")).alias("s"))
    docs = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: F.struct(x["title"].alias("title"), x["text"].alias("text"))).alias("sections"))
    docs = docs.withColumn("text", F.lit("1.1 a\n1.2 b\n1.3 c"))
    return Q.structured(docs, heading_repeats=2).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n"), F.min("id").alias("first"))


QUERIES = {
    f.__name__: f
    for f in (
        cand_semantic, cand_registry, scoped_rows, validated_inputs, broken_links, store_similar, upsert_keeps_created, write_once, resumable_jobs, artifact_facts, dag_outcome,
        table_items, structurer_headings,
    )
}

_KIND = "CASE p_size % 3 WHEN 0 THEN 'POLICY' WHEN 1 THEN 'RECORD' ELSE 'PROCEDURE' END"
ORACLE = {
    "cand_semantic": """WITH p AS (SELECT a.vec_id AS source_id, b.vec_id AS target_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id<>b.vec_id)
      SELECT source_id, target_id, round(s,4) AS score, 'semantic' AS generator FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY s DESC, target_id) AS rn FROM p WHERE s>=0.2) WHERE rn<=3""",
    "cand_registry": """WITH s AS (SELECT 's'||s_suppkey AS source_id, CASE s_nationkey%3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS at FROM supplier), p AS (SELECT p_size%3=0 AS word, CASE p_size%4 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS at FROM part)
      SELECT source_id, CASE WHEN word THEN 'keyword' ELSE 'level' END AS generator, count(*) AS n FROM s, p WHERE word OR p.at < s.at GROUP BY ALL""",
    "scoped_rows": "SELECT doc_id FROM documents WHERE lang='en' AND (source='src1' OR source='src0' OR source IS NULL)",
    "validated_inputs": f"SELECT relationship, count(*) AS n FROM ({I.PAIRS_SQL}) GROUP BY relationship",
    "broken_links": "SELECT 'test' AS step, p_partkey::VARCHAR AS uri, p_size::VARCHAR AS made, (p_size+1)::VARCHAR AS used FROM part WHERE p_partkey%10=0",
    "store_similar": "SELECT b.vec_id AS id, round(list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]),4) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id=0 AND b.label%3=1 ORDER BY list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]) DESC, id LIMIT 10",
    "upsert_keeps_created": "SELECT CASE o_orderstatus WHEN 'O' THEN 'N' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n, min(o_orderdate)::DATE AS first FROM orders GROUP BY 1",
    "write_once": "SELECT 'supplier' AS kind, count(*) AS n FROM supplier UNION ALL SELECT 'customer', count(*) FROM customer",
    "resumable_jobs": "SELECT o_orderkey AS job_id FROM orders WHERE o_orderstatus='P'",
    "artifact_facts": f"WITH a AS (SELECT DISTINCT p_brand, lower(p_name) AS name, {_KIND} AS type FROM part) SELECT 'Artifact' AS label, count(*) AS n FROM a UNION ALL SELECT 'ArtifactType', CASE WHEN count(*) > 0 THEN 9 ELSE 0 END FROM a UNION ALL SELECT 'DEMANDS', count(*) FROM a UNION ALL SELECT 'IS_TYPE', count(*) FROM a",
    "dag_outcome": "SELECT name, status, (SELECT count(*) FROM orders)::BIGINT AS n FROM (VALUES ('classify','completed'),('embedding','completed'),('relationship','failed'),('requires','skipped')) v(name,status)",
    "table_items": """WITH r AS (SELECT l_orderkey, l_linenumber, l_linestatus, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CASE WHEN l_linenumber%4=0 THEN '' ELSE l_linestatus END) AS k FROM lineitem WHERE l_linenumber%5<>0)
      SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber%3=0 OR l_linenumber%4=0 THEN 'tbl-'||k ELSE l_linenumber::VARCHAR END AS id,
        CASE WHEN l_linenumber%4=0 THEN ' | ' WHEN l_linenumber%3=0 THEN '  | '||l_linestatus||' |  ' ELSE ' '||l_linenumber||' | '||l_linestatus||' |  ' END AS text FROM r""",
    "structurer_headings": "WITH c AS (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus) AS place FROM lineitem), d AS (SELECT l_orderkey, count_if(k<=2) AS n, min(CASE WHEN k<=2 THEN 'sec-'||place END) AS lowest FROM c GROUP BY 1) SELECT l_orderkey AS doc_id, CASE WHEN n>0 THEN n ELSE 3 END::BIGINT AS n, coalesce(lowest,'1.1') AS first FROM d",
}
