"""What the corpus operators share: reading tables, and tables written to cut lineage."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words: blank and the five control characters from tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: Used only where a local session names no shared folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/cartulary"


#: Spark's own setting: shuffle files go when the execution that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set; it names the folder that driver and executors share")
    return (named or LOCAL_CHECKPOINTS).rstrip("/")


class Scratch:
    """Tables that one call writes to the shared folder so that later steps read them instead of recomputing.

    A written table survives the loss of any executor. ``drop`` removes one as soon as nothing reads it any more;
    those behind a lazily returned result stay, and the owner of the shared folder expires them.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame) -> DataFrame:
        """Writes and reads back; what was shuffled for it is removed as soon as it is written."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                if folder.startswith(self.root) or self.root.split("://")[-1].lstrip("/") in folder:
                    path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
                    path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(column: Column, divisor: int) -> Column:
    """crc32 of a value's text, modulo ``divisor``; null stays null."""
    return F.crc32(column.cast("string").cast("binary")) % divisor


def words(text: Column) -> Column:
    """The words of a text, parted by SPACE_CLASS; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def with_columns(batch: pa.RecordBatch, keep: list[str], added: dict, types: dict | None = None) -> pa.RecordBatch:
    """The ``keep`` columns of an Arrow batch as they are, then the ``added`` ones; Python ints and arrays become long."""
    arrays = [batch.column(k) for k in keep]
    for name, values in added.items():
        kind = (types or {}).get(name)
        arrays.append(values if isinstance(values, pa.Array) else pa.array(values, type=kind or (pa.int64() if isinstance(values, list) else None)))
    return pa.RecordBatch.from_arrays(arrays, names=[*keep, *added])
