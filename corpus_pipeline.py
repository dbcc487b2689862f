"""The corpus pipeline: quality rules, line dedup, near-dedup, PII, packing; each stage on what the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm.common import ensure_checkpoint_dir, read_table
from scorewright.llm.line_dedup import dedup_lines
from scorewright.llm.near_dedup import dedup_near
from scorewright.llm.packing import pack_documents
from scorewright.llm.pii import sanitise
from scorewright.llm.quality_rules import filter_quality


def recounted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, follows a text that a stage has changed."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_quality(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recounted(dedup_lines(docs).select(*docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_near(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recounted(sanitise(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("PII", pii_stage),
    ("packing", packing_stage),
]

#: The last stage tokenizes, which SQL cannot express; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents; each but the last is written as Parquet in the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    top = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, last = read_table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{top}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            folder = spark._jvm.org.apache.hadoop.fs.Path(last)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
