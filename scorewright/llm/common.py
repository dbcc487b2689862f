"""What the corpus operators share: checkpoints, hashes and the order of spans."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that count as white space in every contract: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names. Where none is named, a local run (as in tests) gets a folder of its own;
    a cluster is refused, since its executors would each write to their own disk."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("name a shared folder in spark.checkpoint.dir")
    if not named:
        named = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, named, True)
    sc.setCheckpointDir(named)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash128(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes; the second starts from another seed."""
    return [F.xxhash64(*cols).alias("__h1"), F.xxhash64(F.lit(0x5BD1E995), *cols).alias("__h2")]


def let(value: Column, body) -> Column:
    """body(value) with value computed once, even where body uses it in nested lambdas."""
    return F.transform(F.array(value), body)[0]
