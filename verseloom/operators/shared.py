"""Helpers of several operators: cut lineage, tables of requests in passes of bounded size, joins on keys that many rows share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000  # rows of a table that is sent to all executors, at most
HOT_KEYS = 200  # a key with more than this part of all rows is split, so there are fewer hot keys than this
SPLITS = 64  # parts of a hot key


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return it with its lineage cut; a folder of our own only where one machine runs all."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def request_table(spark, requests: list | DataFrame, column: str) -> DataFrame:
    """Distinct requests as a table, be they a list or a table of any size already."""
    if isinstance(requests, DataFrame):
        return requests.select(column).where(F.col(column).isNotNull()).distinct()
    return spark.createDataFrame([(r,) for r in dict.fromkeys(requests)], f"{column} string")


def in_passes(requests: DataFrame, column: str, letters: int) -> Iterator[list[str]]:
    """The distinct values of a column, in lists that a driver and an executor can hold: about ``letters`` in each."""
    values = checkpointed(requests.select(column).where(F.col(column).isNotNull()).distinct())
    size = values.agg(F.coalesce(F.sum(F.length(column)), F.lit(0))).first()[0]
    passes = max(1, -(-size // letters))
    for p in range(passes):
        mine = values if passes == 1 else values.where(F.pmod(F.xxhash64(column), F.lit(passes)) == p)
        found = [r[0] for r in mine.collect()]
        if found:
            yield found


def join_counted(rows: DataFrame, table: DataFrame, key: str, total: int, spread: list[str], few: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` joined to ``table(key, n, ...)`` on ``key``; ``n`` tells how many of the ``total`` rows have the key.

    A table of up to ``few`` rows is sent to all executors. Otherwise both sides are dealt
    by key, and the rows of a hot one by a hash of their ``spread`` columns too:
    the table's rows of it are repeated for each part.
    """
    table = checkpointed(table)
    if table.count() <= few:
        return rows.join(F.broadcast(table.drop("n")), key)
    hot = [r[0] for r in table.where(F.col("n") * HOT_KEYS > total).select(key).distinct().collect()]
    if not hot:
        return rows.join(table.drop("n"), key)
    part: Column = F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(*spread), F.lit(SPLITS)).cast("int"))
    parts = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(SPLITS - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.withColumn("__part", F.coalesce(part, F.lit(0)))
    return dealt.join(table.drop("n").withColumn("__part", F.explode(parts)), [key, "__part"]).drop("__part")
