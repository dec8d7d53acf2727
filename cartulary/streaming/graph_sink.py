"""Stages that ended, taken from the stream into the graph."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.operators import graph
from cartulary.streaming.bus import tenant_of

#: Which edges an analyzer's results become.
EDGES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "relationship": lambda r: graph.relationship_edges(r, F.col("analyzed_at")),
    "requires": lambda r: graph.requires_edges(r.withColumn("decision", F.col("relationship") == "REQUIRES")),
}


def completed(messages: DataFrame) -> DataFrame:
    """(tenant_id, job_id, analyzer) of messages (subject, data) that tell of an ended stage.

    The subject is app.pipeline.tenant.job.stage.completed; a shorter one, another tenant token than letters, digits,
    dashes and underscores, data that is no JSON, or one without analyzer or job_id, is passed over.
    """
    value = lambda name: F.get_json_object("data", f"$.{name}")
    told = messages.where((F.size(F.split("subject", r"\.")) >= 6) & F.col("subject").endswith(".stage.completed") & tenant_of(F.col("subject")).rlike("^[A-Za-z0-9_-]+$"))
    told = told.select(tenant_of(F.col("subject")).alias("tenant_id"), value("job_id").alias("job_id"), value("analyzer").alias("analyzer"))
    return told.where((F.coalesce("job_id", F.lit("")) != "") & (F.coalesce("analyzer", F.lit("")) != ""))


def new_edges(messages: DataFrame, results: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges that the results (tenant_id, job_id, analyzer, source_id, target_id, relationship, confidence,
    analyzed_at) of ended stages add to ``edges``; what is there already is not added again."""
    ended = completed(messages).distinct()
    own = results.join(ended, ["tenant_id", "job_id", "analyzer"], "left_semi")
    made = None
    for analyzer, make in EDGES.items():
        part = make(own.where(F.col("analyzer") == analyzer))
        made = part if made is None else made.unionByName(part)
    return made.dropDuplicates(["tenant_id", "id"]).join(edges.select("tenant_id", "id"), ["tenant_id", "id"], "left_anti")


#: So many tenants of a batch are named to the reader of the edges, which then opens only their folders.
MOST_NAMED = 1000


class EdgeStore:
    """Edges in folders by tenant and batch, and a log of the batches that were written whole.

    A batch's folders are its own: a batch that is run again after it was stopped half way replaces what it left, and
    one that is in the log is passed over. Only batches of the log are read. So each edge is there once, whatever is
    stopped and when. One query writes to a store at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        props = T.MapType(T.StringType(), T.StringType())
        kinds = {"id": T.StringType(), "label": T.StringType(), "source_id": T.StringType(), "target_id": T.StringType(), "valid_from": T.TimestampType(), "valid_to": T.TimestampType(), "props": props}
        self.columns = ["tenant_id", *kinds]
        self.schema = T.StructType([*[T.StructField(k, v) for k, v in kinds.items()], T.StructField("tenant_id", T.StringType()), T.StructField("batch", T.StringType())])

    def _there(self, folder: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def log(self) -> DataFrame:
        """(batch, n) of the batches that were written whole."""
        kind = "batch string, n long"
        return self.spark.read.schema(kind).json(f"{self.path}/log/*") if self._there("log") else self.spark.createDataFrame([], kind)

    def edges(self, tenants: list[str] | None = None) -> DataFrame:
        """The edges of the batches in the log; of these tenants only, whose folders are the only ones that are read."""
        if not self._there("edges"):
            return self.spark.createDataFrame([], self.schema).select(self.columns)
        found = self.spark.read.schema(self.schema).parquet(f"{self.path}/edges")
        found = found.where(F.col("tenant_id").isin(*tenants)) if tenants else found
        return found.join(self.log().select("batch"), "batch", "left_semi").select(self.columns)

    def append(self, new: DataFrame, query: str, batch_id: int) -> bool:
        """Writes the edges of a batch, then the log; False if the log has the batch already."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", query):
            raise ValueError(f"bad name of a query {query!r}")
        batch = f"{query}-{batch_id}"
        if self._there(f"log/{batch}"):
            return False
        rows = new.select(self.columns).withColumn("batch", F.lit(batch)).repartition("tenant_id", F.pmod(F.xxhash64("id"), F.lit(8)))
        watched = Observation()
        (
            rows.observe(watched, F.count("*").alias("n"))
            .write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("tenant_id", "batch").parquet(f"{self.path}/edges")
        )
        line = self.spark.createDataFrame([(batch, int(watched.get["n"]))], "batch string, n long")
        line.coalesce(1).write.mode("overwrite").json(f"{self.path}/log/{batch}")  # seen when it is whole
        return True

    def take(self, messages: DataFrame, results: DataFrame, query: str, batch_id: int) -> bool:
        """Appends what the ended stages of a batch of messages add. Only edges of the tenants that messages are of are read."""
        named = [r.tenant_id for r in completed(messages).select("tenant_id").distinct().limit(MOST_NAMED + 1).collect()]
        held = self.edges(named if 0 < len(named) <= MOST_NAMED else None)
        return self.append(new_edges(messages, results, held), query, batch_id)


def sink(results: DataFrame, path: str, query: str | None = None) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: a batch's new edges go to the ``EdgeStore`` at ``path``, exactly once.

    Unless a name is given a query goes by its id, which it keeps when it is started again from its checkpoint.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        name = query or batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        EdgeStore(batch.sparkSession, path).take(batch, results, name, batch_id)

    return write
