"""The corpus pipeline: five operators, each applied to all that the one before it kept.

Every stage takes (spark, docs, sf_dir), ``docs`` with the columns of documents, and returns a DataFrame; all but the
last return the columns of documents again. Empty tables pass through; a null text is an empty one to every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from cartulary.llm import line_dedup, packing, passage_quality, secret_scans, shingle_join
from cartulary.llm.shared import Scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Bytes of text that are handed to Python at once; a longer text goes alone. Buffers outside of the heap follow it.
BATCH_BYTES = 4 << 20


def _bounded(spark: SparkSession) -> None:
    """For the session, since what a stage returns runs later."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _as_documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return df.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the attention classifier predicts to be of label 1."""
    _bounded(spark)
    model = passage_quality.trained(docs, table(spark, sf_dir, "labels"))
    return passage_quality.score(docs, model).where("predicted = 1").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes blocks of lines that an earlier document has; a document that loses all its words goes."""
    _bounded(spark)
    cut = line_dedup.dedup(docs, Scratch(spark, "pipeline-lines"))
    left = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return _as_documents(cut.where((F.col("n_deleted") == 0) | left))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each component of near duplicates (five words, 0.8 or more), and
    one of rows that repeat. What has no doc_id stays only in a component where nothing has one, and then one of it."""
    _bounded(spark)
    return shingle_join.distinct_documents(docs, Scratch(spark, "pipeline-near"), width=5, percent=80).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; all documents stay."""
    _bounded(spark)
    found = secret_scans.scan(docs)
    return _as_documents(found.withColumn("text", secret_scans.redact(F.col("text"), F.col("spans"))))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into windows of 1024 tokens; a row for each piece."""
    _bounded(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), Scratch(spark, "pipeline-pack"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scans", mask_secrets),
    ("packing", pack_windows),
]

#: The classifier and the packing plan are not SQL. Tests hold each stage against its operator, and the operators against
#: brute force (the classifier against labels that were held out).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder; each stage's result is written and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.write(docs)
    return docs
