"""How many tasks a step gets: as many as its input asks for, not a number fixed beforehand."""

from __future__ import annotations

from pyspark.sql import DataFrame


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that a plan reads, as far as Spark knows them without running it."""
    if df.isStreaming:
        return 0
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 50)  # an unknown size is given as a huge one


def by_key(df: DataFrame, *keys: str, each: int = 4 << 20) -> DataFrame:
    """Rows dealt by keys over a task for each so many bytes of input, so that what a task holds does not grow
    with the tables; input of fewer tasks than there are cores is left to Spark's own shuffles."""
    n = -(-input_bytes(df) // each)
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df


def over_cores(df: DataFrame, *keys: str, each: int = 1 << 17) -> DataFrame:
    """Rows dealt by keys over all cores, for work on each row that is heavy beside the few bytes it is read from:
    a small file would be one task."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(df) // each)), *keys)
