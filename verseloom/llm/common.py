"""Helpers that several operators share."""

from __future__ import annotations

import gc
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word rules: space and U+0009 to U+000D.
WORD_SPACE = " \t\n\x0b\x0c\r"
WORD_SPACE_CLASS = r"[\x20\x09-\x0D]"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the cluster's shared folder; set one of our own only where none is named and one machine runs all."""
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and return it with its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WORD_SPACE))
    empty = F.array().cast("array<string>")
    return F.when(trimmed == "", empty).otherwise(F.split(trimmed, WORD_SPACE_CLASS + "+"))


_memos: list[Memo] = []
_serving: list[str] = [""]


def serving(owner: str) -> None:
    """Drop what this worker has kept for other operators: workers go on from one stage to the next."""
    if _serving[0] != owner:
        _serving[0] = owner
        for memo in _memos:
            if memo.owner != owner:
                memo.old = {}
                memo.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


class Memo(dict):
    """Results of ``make`` by key, at most twice ``limit`` of them: keys not met for a while are made anew."""

    def __init__(self, make, limit: int = 500_000, key_size: int = 64, owner: str = "") -> None:
        super().__init__()
        gc.set_threshold(200_000, 20, 100)  # many plain objects, no cycles: full collections cost more than they free
        self.make, self.limit, self.key_size, self.old = make, limit, key_size, {}
        self.owner = owner
        if owner:
            _memos.append(self)

    def __missing__(self, key):
        value = self.old[key] if key in self.old else self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if not isinstance(key, str) or len(key) <= self.key_size:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value

    def holds(self, key) -> bool:
        return key in self or key in self.old
