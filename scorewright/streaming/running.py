"""Running scores of a stream of results. An extension: the batch statistics are the ones of record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_scores(results: DataFrame, time_col: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """For each window and model: samples, errored and the mean with errors as failures; late rows beyond the watermark are
    dropped by the engine. Works on a stream and on a table."""
    value = F.coalesce(F.col("score") / F.col("max_score"), F.lit(0.0))
    return (
        results.withWatermark(time_col, late)
        .groupBy(F.window(time_col, window), "model")
        .agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("score").isNull()).alias("errored"), F.avg(value).alias("score"))
        .select(F.col("window.start").alias("start"), "model", "samples", "errored", "score")
    )
