"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseloom.llm.common import checkpointed


EACH = 20_000  # edges a task, at least, where there are enough
HOT = 1_000  # rows from which on a key goes to the executors instead of being a task's own
SENT = 100_000  # keys that go to the executors, at most


def join_groups(rows: DataFrame, groups: DataFrame, key: str, total: int = 0) -> DataFrame:
    """``rows`` joined to ``groups(key, c, ...)``, which has one row a key and tells the number ``c`` of its rows.

    Keys of more than ``HOT`` rows are broadcast and their rows stay where they
    are; the others are joined by key. ``total`` is the number of all rows, or
    more (0: it is small): beyond ``HOT`` times ``SENT`` a key must have more than a ``SENT``-th of
    them, so there are never more than ``SENT`` such keys.
    """
    hot = max(HOT, total // SENT)
    large = groups.where(F.col("c") > hot).drop("c")
    small = groups.where(F.col("c") <= hot).drop("c")
    rest = rows.join(F.broadcast(large.select(key)), key, "left_anti")
    return rows.join(F.broadcast(large), key).unionByName(rest.join(small, key))


class Forest:
    """Union-find over the ids that one task meets; ``add`` is true for edges that join two trees."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def add(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.parent[b] = a
        return True


def _stars(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replace a task's edges by one edge from each id to the smallest id it reaches in the task."""
    forest = Forest()
    for frame in frames:
        for hi, lo in zip(frame["hi"].tolist(), frame["lo"].tolist()):
            forest.add(hi, lo)
    ids = [x for x in list(forest.parent) if forest.find(x) != x]
    for k in range(0, len(ids), 50_000):
        part = ids[k : k + 50_000]
        yield pd.DataFrame({"hi": part, "lo": [forest.find(x) for x in part]}, dtype="int64")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Map each id of ``edges(a, b)`` to the smallest id it reaches: ``node``, ``component`` (long).

    Edges with a null end and loops add no link; repeated edges count once; an
    empty table gives an empty result. Each round is a large-star and a
    small-star step over the edge table (a logarithmic number in practice) and
    ends in a checkpoint, so lost executors cost one round. Only two numbers a
    round reach the driver.
    """
    edges = edges.select(
        F.greatest("a", "b").cast("long").alias("hi"), F.least("a", "b").cast("long").alias("lo")
    ).where("a is not null and b is not null and a != b")
    edges = checkpointed(edges.mapInPandas(_stars, "hi long, lo long"))
    tasks = edges.count() // EACH + 1
    # few edges in many tasks: each step would write more files than rows
    edges = checkpointed(edges.coalesce(tasks).mapInPandas(_stars, "hi long, lo long"))
    if tasks == 1:
        return _named(edges)
    edges = checkpointed(edges.distinct())
    state = _state(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        # large-star: neighbours above u hang under the smallest of u and its neighbours
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).withColumn("m", F.least("u", "m"))
        large = (
            join_groups(both, least, "u", 2 * state[0]).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        ).distinct()
        # small-star: u and its smaller neighbours hang under the smallest of them
        lows = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("c"))
        small = (
            join_groups(large, lows, "hi", 2 * state[0]).where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        ).union(lows.select("hi", F.col("m").alias("lo")))
        edges = checkpointed(small.distinct())
        before, state = state, _state(edges)
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return _named(edges)


def _named(edges: DataFrame) -> DataFrame:
    roots = edges.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
