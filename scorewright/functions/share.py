"""How rows come to the Python stages: dealt out by number, worked on in bounded batches, and equal texts read once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

from pyspark.sql import DataFrame

#: A text longer than this is not kept for a second time that it is asked for.
KEPT_CHARACTERS = 10_000
#: Characters of results that a task holds before it passes them on.
BATCH_CHARACTERS = 4_000_000


def dealt_evenly(df: DataFrame) -> DataFrame:
    """The rows dealt out by number over all cores. Each costs Python's time and few bytes, so that the splits of a file, which are
    by bytes, would leave most cores idle; a fixed number, as adaptive execution would join small parts again."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def read_once(df: DataFrame) -> DataFrame:
    """df, computed once for all its readers, by the first. A cached frame is not met again in a query that takes it by name, as
    spark.sql does; this one is held on the executors, in memory or on disk, and a lost executor ends the query."""
    return df.localCheckpoint(eager=False)


def kept(size: int, longest: int = KEPT_CHARACTERS) -> Callable[[Callable], Callable]:
    """Keep what a pure function of texts gave for the last few; nothing of a long one."""

    def around(f: Callable) -> Callable:
        held = lru_cache(maxsize=size)(f)

        @wraps(f)
        def asked(*a):
            return held(*a) if sum(len(x) for x in a if isinstance(x, str)) <= longest else f(*a)

        return asked

    return around


def bounded(rows: Iterator[tuple], size: Callable[[tuple], int]) -> Iterator[list[tuple]]:
    """The rows in lists of BATCH_CHARACTERS at most, or of one longer row."""
    out, held = [], 0
    for r in rows:
        out.append(r)
        held += size(r)
        if held >= BATCH_CHARACTERS:
            yield out
            out, held = [], 0
    if out:
        yield out
