"""Files: tenants' objects, exports, and results by address."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def safe_key(tenant: str, key: str) -> str:
    """tenant/key; a key is relative and stays inside its tenant."""
    if not key or key.startswith("/") or "\\" in key or "\0" in key or ".." in key.split("/"):
        raise ValueError(f"bad key {key!r}")
    return f"{tenant}/{key}"


class Objects:
    """A tenant's objects below a root that Hadoop's file systems can reach."""

    def __init__(self, spark: SparkSession, root: str, tenant: str):
        self.spark, self.root, self.tenant = spark, root.rstrip("/"), tenant

    def _path(self, key: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{safe_key(self.tenant, key)}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def put(self, key: str, data: bytes) -> None:
        path, fs = self._path(key)
        out = fs.create(path, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def get(self, key: str) -> bytes:
        if not self.exists(key):
            raise LookupError(key)
        return bytes(self.spark.read.format("binaryFile").load(f"{self.root}/{safe_key(self.tenant, key)}").first()["content"])

    def exists(self, key: str) -> bool:
        path, fs = self._path(key)
        return bool(fs.exists(path))

    def delete(self, key: str) -> None:
        """Deleting what is not there is no error."""
        path, fs = self._path(key)
        fs.delete(path, True)

    def stat(self, key: str) -> dict:
        path, fs = self._path(key)
        if not fs.exists(path):
            raise LookupError(key)
        s = fs.getFileStatus(path)
        return {"key": key, "size": s.getLen(), "modified_ms": s.getModificationTime()}

    def all(self, prefix: str = "") -> DataFrame:
        """(path, length, modificationTime) of the objects below a folder."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{self.root}/{self.tenant}/{prefix}".rstrip("/"))
        return files.select("path", "length", "modificationTime")


def export_mappings(rows: DataFrame, path: str, form: str = "json") -> None:
    """Seven columns of mappings as JSON lines or CSV; confidence and viability with three digits."""
    shown = rows.select(
        "source_id", "target_id", "relationship", F.format_string("%.3f", F.col("confidence")).alias("confidence"),
        F.format_string("%.3f", F.col("viability_weight")).alias("viability"), "source_type", "target_type",
    )
    if form not in ("json", "csv"):
        raise ValueError(f"unknown form {form}")
    (shown.write.json if form == "json" else lambda p: shown.write.csv(p, header=True))(path)


def export_matrix(matrix: DataFrame, path: str) -> None:
    """A similarity matrix as CSV with a header; an empty one writes nothing."""
    if not matrix.isEmpty():
        matrix.write.csv(path, header=True)


class Resolvers:
    """Loaders of results by the scheme of their address."""

    def __init__(self) -> None:
        self.loaders: dict[str, Callable[[str], DataFrame]] = {}

    def register(self, scheme: str, loader: Callable[[str], DataFrame]) -> None:
        self.loaders[scheme] = loader

    def resolve(self, uri: str) -> DataFrame:
        scheme, mark, rest = uri.partition("://")
        if not mark or scheme not in self.loaders:
            raise LookupError(f"no loader for {uri}")
        return self.loaders[scheme](rest)


def results_loader(spark: SparkSession, root: str) -> Callable[[str], DataFrame]:
    """results/{job}/{analyzer} from Parquet folders of that name."""

    def load(rest: str) -> DataFrame:
        parts = rest.split("/")
        if len(parts) != 3 or parts[0] != "results" or not all(parts) or ".." in parts:
            raise ValueError(f"bad address {rest}")
        return spark.read.parquet(f"{root}/{parts[1]}/{parts[2]}")

    return load


def landed(spark: SparkSession, path: str, most_bytes: int = 134_217_728) -> DataFrame:
    """Uploaded files (path, modificationTime, length, content, error). One of more than ``most_bytes`` has no content but
    an error; its bytes are not read: the size filters are pushed into the listing."""
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= most_bytes).withColumn("error", F.lit(None).cast("string"))
    large = files.where(F.col("length") > most_bytes).drop("content")
    refused = large.withColumns({"content": F.lit(None).cast("binary"), "error": F.lit(f"upload exceeds maximum size of {most_bytes} bytes")})
    return small.unionByName(refused)
