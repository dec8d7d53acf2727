"""The driver's tables read as the engine's: the same mappings as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RELATIONSHIP_CASE = (
    "CASE l_linenumber WHEN 1 THEN 'EQUIVALENT' WHEN 2 THEN 'SUPERSET_OF' WHEN 3 THEN 'SUBSET_OF' WHEN 4 THEN 'CONTRIBUTES_TO' "
    "WHEN 5 THEN 'COMPLEMENTS' WHEN 6 THEN 'PARTIAL' ELSE 'NO_RELATIONSHIP' END"
)
PAIRS_SQL = (
    "SELECT l_orderkey * 10 + l_linenumber AS pos, CAST(l_suppkey AS VARCHAR) AS source_id, CAST(l_partkey AS VARCHAR) AS target_id, "
    "CAST(l_quantity AS DOUBLE) * 2 AS score, CAST(l_discount AS DOUBLE) * 10 AS confidence, l_returnflag = 'N' AS unanimous, "
    f"{RELATIONSHIP_CASE} AS relationship, CASE WHEN l_linestatus = 'O' THEN 'INTEGRAL_TO' ELSE '' END AS contribution FROM lineitem"
)
CLASSES_SQL = (
    "SELECT CAST(p_partkey AS VARCHAR) AS control_id, CASE p_size % 4 WHEN 0 THEN 'Technical' WHEN 1 THEN 'Procedural' WHEN 2 THEN 'Both' ELSE 'None' END AS type, "
    "CASE p_size % 3 WHEN 0 THEN 'Strategic' WHEN 1 THEN 'Tactical' ELSE 'Operational' END AS level FROM part WHERE p_size % 7 <> 0"
)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored pairs: supplier as source, part as target."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.col("l_suppkey").cast("string").alias("source_id"),
        F.col("l_partkey").cast("string").alias("target_id"),
        (F.col("l_quantity").cast("double") * 2).alias("score"),
        (F.col("l_discount").cast("double") * 10).alias("confidence"),
        (F.col("l_returnflag") == "N").alias("unanimous"),
        F.expr(RELATIONSHIP_CASE).alias("relationship"),
        F.when(F.col("l_linestatus") == "O", "INTEGRAL_TO").otherwise("").alias("contribution"),
    )


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as classified controls; some are not classified."""
    return table(spark, sf_dir, "part").where("p_size % 7 <> 0").select(
        F.col("p_partkey").cast("string").alias("control_id"),
        F.expr("CASE p_size % 4 WHEN 0 THEN 'Technical' WHEN 1 THEN 'Procedural' WHEN 2 THEN 'Both' ELSE 'None' END").alias("type"),
        F.expr("CASE p_size % 3 WHEN 0 THEN 'Strategic' WHEN 1 THEN 'Tactical' ELSE 'Operational' END").alias("level"),
    )


#: Orders as temporal edges customer -> order priority: each holds until the customer's next order.
EDGES_SQL = (
    "SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS source_id, o_orderpriority AS target_id, o_orderstatus AS label, "
    "o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders"
)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.lit("acme").alias("tenant_id"),
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderstatus").alias("label"),
        F.col("o_custkey").cast("string").alias("source_id"),
        F.col("o_orderpriority").alias("target_id"),
        F.col("o_orderdate").alias("valid_from"),
        F.lead("o_orderdate").over(w).alias("valid_to"),
        F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("props"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ends of ``edges``: customers, and order priorities."""
    start = F.lit("1990-01-01").cast("timestamp").alias("valid_from")
    open_end = F.lit(None).cast("timestamp").alias("valid_to")
    customers = table(spark, sf_dir, "customer").select(
        F.lit("acme").alias("tenant_id"), F.col("c_custkey").cast("string").alias("id"), F.lit("Customer").alias("label"), start, open_end,
        F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("props"),
    )
    priorities = table(spark, sf_dir, "orders").select("o_orderpriority").distinct().select(
        F.lit("acme").alias("tenant_id"), F.col("o_orderpriority").alias("id"), F.lit("Priority").alias("label"), start, open_end,
        F.create_map().cast("map<string,string>").alias("props"),
    )
    return customers.unionByName(priorities)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PARENT_OF edges region -> nation -> supplier."""
    def edge(df: DataFrame, parent: str, child: str, a: str, b: str) -> DataFrame:
        s, t = F.concat(F.lit(a), parent), F.concat(F.lit(b), child)
        return df.select(
            F.lit("acme").alias("tenant_id"), F.concat(s, F.lit(">"), t).alias("id"), F.lit("PARENT_OF").alias("label"), s.alias("source_id"), t.alias("target_id"),
            F.lit("1990-01-01").cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"),
        )

    return edge(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "r", "n").unionByName(edge(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", "n", "s"))


PLACES_SQL = (
    "SELECT 'r' || n_regionkey AS source_id, 'n' || n_nationkey AS target_id FROM nation UNION ALL "
    "SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier"
)

#: Events as a panel's votes on a pair.
VOTES_SQL = (
    "SELECT CAST(user_id AS VARCHAR) AS pair_id, CAST(event_id AS VARCHAR) AS vote_key, "
    "CASE event_id % 8 WHEN 0 THEN 'EQUIVALENT' WHEN 1 THEN 'SUPERSET_OF' WHEN 2 THEN 'CONTRIBUTES_TO' WHEN 3 THEN 'CONTRIBUTES_TO' WHEN 4 THEN 'PARTIAL' "
    "WHEN 5 THEN 'CONTRIBUTES_TO' ELSE 'NO_RELATIONSHIP' END AS relationship, CASE event_id % 3 WHEN 0 THEN 'INTEGRAL_TO' WHEN 1 THEN 'EXAMPLE_OF' ELSE '' END AS contribution, "
    "CASE WHEN event_id % 11 = 0 THEN 'PARSE_FAIL' ELSE 'OK' END AS parse_status, "
    "CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 2 = 0 END AS decision, CAST(event_id % 4 AS DOUBLE) AS weight FROM events"
)


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("_cartulary_events")
    return spark.sql(VOTES_SQL.replace("VARCHAR", "STRING").replace("FROM events", "FROM _cartulary_events"))
