"""Where a tenant's graph is kept: two Parquet tables below one folder that all machines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartulary.operators.tables import TENANT

NODES = "tenant_id string, id string, label string, valid_from timestamp, valid_to timestamp, props map<string,string>"
EDGES = "tenant_id string, id string, label string, source_id string, target_id string, valid_from timestamp, valid_to timestamp, props map<string,string>"


def _folder(spark: SparkSession, root: str, tenant: str):
    """A tenant's folder, its file system, and its place as text."""
    if not TENANT.fullmatch(tenant or ""):
        raise PermissionError(f"no valid tenant: {tenant!r}")
    place = f"{root.rstrip('/')}/{tenant}"
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, root: str, tenant: str) -> bool:
    path, files, _ = _folder(spark, root, tenant)
    return files.exists(path)


def create(spark: SparkSession, root: str, tenant: str) -> bool:
    """An empty graph; whether it was made. One that exists stays as it is."""
    if exists(spark, root, tenant):
        return False
    place = _folder(spark, root, tenant)[2]
    for name, schema in (("nodes", NODES), ("edges", EDGES)):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{place}/{name}")
    return True


def read(spark: SparkSession, root: str, tenant: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges); a graph that does not exist is an error."""
    if not exists(spark, root, tenant):
        raise LookupError(f"no graph of {tenant}")
    place = _folder(spark, root, tenant)[2]
    return spark.read.schema(NODES).parquet(f"{place}/nodes"), spark.read.schema(EDGES).parquet(f"{place}/edges")


def drop(spark: SparkSession, root: str, tenant: str) -> None:
    """Takes away a tenant's graph with all its facts; one that does not exist is an error."""
    path, files, _ = _folder(spark, root, tenant)
    if not files.exists(path):
        raise LookupError(f"no graph of {tenant}")
    files.delete(path, True)
