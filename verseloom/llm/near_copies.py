"""Near copies at a Jaccard similarity of word shingles: the pipeline's SimHash stage.

Fingerprints within ``simhash.MAX_BITS`` bits are found by the index of one-wildcard
segment variants. SimHash bits alone can't index a similarity of 0.8 (about ten of
64 bits differ there, up to 20 in practice), so candidates are also documents that
agree in a band of minimum hashes and differ in at most ``WIDE`` bits of their
fingerprints; each link is then checked by the exact Jaccard similarity of the
shingle sets.

A bucket of the bands first links its rows to the one nearest to the bits' majority.
The rows of buckets that this leaves in several components are then joined by their
rarest shingles, so many that no two of them at the similarity are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verseloom.llm.common import checkpointed, serving
from verseloom.llm.components import EACH, connected_components
from verseloom.llm.simhash import fingerprint_links

SEED = 42
SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6  # at 0.8 a pair misses all bands with a chance of (1 - 0.8**6)**32 = 6e-5
WIDE = 26  # bits; at 0.8 about 10 differ, with a deviation of about 3
BAND = 1.02  # ratio of the sizes in a band
SLACK = 1e-6  # for rounding: a bound lets a pair pass sooner than drop it
SENT = 1_000_000  # keys up to which they go to each executor, so that no text is shuffled
_factors = (np.random.default_rng(SEED).integers(0, 2**31, BANDS * ROWS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_mix = np.random.default_rng(SEED + 1).integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles; a text of fewer words is one, a blank one has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    starts = (ends - sizes).tolist()
    return np.unique(
        np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist())], dtype=np.uint64)
    )


def sketch(hashes: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """Digest of a shingle set, its fingerprint, its size, and one key for each band."""
    n = len(hashes)
    node = int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).astype(np.int64))
    if not n:
        return node, 0, 0, np.zeros(0, dtype=np.int64)
    ones, least = np.zeros(64, dtype=np.int64), np.full(BANDS * ROWS, 2**32 - 1, dtype=np.uint32)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    for k in range(0, n, 1024):
        part = hashes[k : k + 1024]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        np.minimum(least, (high[k : k + 1024, None] * _factors).min(axis=0), out=least)
    fp = int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])
    keys = ((least.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * _mix).sum(axis=1, dtype=np.uint64)
    return node, fp, n, keys.view(np.int64)


def _sketches(text: Column, shingle: int) -> Column:
    @F.pandas_udf("node long, fp long, n long, keys array<long>")
    def run(texts: pd.Series) -> pd.DataFrame:
        serving("near copies")
        return pd.DataFrame([sketch(shingles(t, shingle)) for t in texts], columns=["node", "fp", "n", "keys"])

    return run(text)


def _sets(text: Column, shingle: int) -> Column:
    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, shingle).view(np.int64) for t in texts], dtype="object")

    return run(text)


def _heads(fps: np.ndarray, sizes: np.ndarray, least: float) -> np.ndarray:
    """For each row of a bucket the row it is compared with first; itself for those."""
    heads, rest = np.arange(len(fps)), np.arange(len(fps))
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").mean(axis=0) > 0.5
    majority = np.packbits(bits, bitorder="little").view(np.uint64)[0]
    head = int(np.argmin(np.bitwise_count(fps ^ majority)))
    while len(rest) > 1:
        near = (np.bitwise_count(fps[rest] ^ fps[head]) <= WIDE) | (len(fps) == 2)  # a single pair is compared whatever its bits
        near &= np.minimum(sizes[rest], sizes[head]) >= least * np.maximum(sizes[rest], sizes[head])
        near |= rest == head
        heads[rest[near]] = head
        rest = rest[~near]
        if len(rest):
            head = int(rest[0])
    return heads


def _buckets(least: float):
    def done(rows: np.ndarray) -> pd.DataFrame:
        out = []
        cuts = np.flatnonzero(np.diff(rows[:, 0])) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)]):
            if e - s > 1:
                part = rows[s:e]
                heads = _heads(np.ascontiguousarray(part[:, 2]).view(np.uint64), part[:, 3], least)
                out.append(np.column_stack((part[:, :2], part[heads, 1], np.full(e - s, e - s))))
        got = np.concatenate(out) if out else np.zeros((0, 4), dtype=np.int64)
        return pd.DataFrame(got, columns=["key", "node", "head", "members"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            rows = frame[["key", "node", "fp", "n"]].to_numpy(dtype=np.int64)
            rows = rows if held is None else np.concatenate((held, rows))
            last = np.flatnonzero(rows[:, 0] != rows[-1, 0]) if len(rows) else []
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield done(rows[:cut])
            held = rows[cut:]
        if held is not None and len(held):
            yield done(held)

    return run


def _gathered(rows: DataFrame) -> DataFrame:
    """``rows``, written, in no more partitions than their number is worth."""
    rows = checkpointed(rows)
    return rows.coalesce(rows.count() // EACH + 1)


def _sent(keys: DataFrame) -> DataFrame:
    """``keys``, marked for a broadcast if they are few."""
    keys = checkpointed(keys)
    return F.broadcast(keys) if keys.count() <= SENT else keys


def _sets_of(nodes: DataFrame, docs: DataFrame, prints: DataFrame, shingle: int) -> DataFrame:
    """The shingle set of each of ``nodes``: ``node``, ``set``."""
    # one document of each node gives its set; copies are put together before the join
    one = F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("i"), F.col("hash").alias("h")))
    chosen = prints.groupBy("node").agg(one.alias("k")).join(nodes, "node", "left_semi")
    chosen = _sent(chosen.select("node", F.col("k.i").alias("__i"), F.col("k.h").alias("__h")))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    texts = texts.join(chosen, (texts["hash"] == chosen["__h"]) & texts["doc_id"].eqNullSafe(chosen["__i"]))
    texts = texts.select("node", "text").dropDuplicates(["node"])
    return checkpointed(texts.select("node", _sets(F.col("text"), shingle).alias("set")))


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs ``a``, ``b`` of nodes whose shingle sets reach the similarity."""
    left, right = (sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    near = both >= F.lit(least) * (F.size("set_a") + F.size("set_b") - both)
    return _gathered(pairs.join(left, "a").join(right, "b").where(near).select("a", "b"))


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _fronts(sets: DataFrame, part: DataFrame, least: float) -> DataFrame:
    """The rarest shingles of each set, as many as a set that reaches the similarity with it must share one of.

    ``node``, ``component``, ``n``, ``h`` and its place ``p`` from 1; a shingle of one set only is left out.
    """
    each = sets.select("node", F.size("set").alias("n"), F.explode("set").alias("h"))
    counts = each.groupBy("h").agg(F.count("*").alias("c"))
    # a set holds a shingle once, so that no shingle has more rows than there are sets
    ordered = each.join(counts, "h").groupBy("node").agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("c", "h"))).alias("row")
    )
    front = F.slice("row", F.lit(1), F.col("n") - F.ceil(F.lit(least) * F.col("n") - SLACK).cast("int") + 1)
    rows = ordered.select("node", "n", F.posexplode(front).alias("p", "s")).where("s.c > 1")
    rows = rows.select("node", "n", F.col("s.h").alias("h"), (F.col("p") + 1).alias("p"))
    return rows.join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _band(size: Column) -> Column:
    return F.floor(F.log(size) / F.lit(np.log(BAND))).cast("long")


def _across(fronts: DataFrame, least: float) -> DataFrame:
    """Pairs of nodes in different components that can reach the similarity, by a shared shingle of their fronts.

    A pair's first shared shingle, at places p and q, leaves at most
    1 + min(n - p, m - q) shared ones, and the similarity asks for
    least / (1 + least) * (n + m). So a place bounds the other set's size, and sets
    meet only by shingle and band of sizes: those of a large group that differ
    from each other meet by what they share rarely, not by what all of them share.
    """
    ratio = (1 + least) / least
    kinds = fronts.groupBy("h", "component").count().groupBy("h").agg(
        F.max_by("component", F.struct("count", "component")).alias("largest"), F.count("*").alias("kinds")
    )
    rows = fronts.join(kinds.where("kinds > 1"), "h").select(
        "h", "node", "n", "p", "component", (F.col("component") != F.col("largest")).alias("other")
    )
    rows = checkpointed(rows)
    room = F.lit(ratio) * (1 + F.col("n") - F.col("p")) - F.col("n") + SLACK
    bands = F.sequence(_band(F.lit(least) * F.col("n") - SLACK), _band(F.least(F.col("n").cast("double"), room)))
    larger = rows.select("h", F.explode(bands).alias("band"), "node", "n", "p", "component", "other")
    # of two sets the smaller one shares a shingle of a shorter front
    smaller = rows.where(room >= F.col("n")).select(
        "h", _band(F.col("n")).alias("band"), *[F.col(c).alias(f"{c}_y") for c in ("node", "n", "p", "component", "other")]
    )
    enough = F.lit(ratio) * (1 + F.least(F.col("n") - F.col("p"), F.col("n_y") - F.col("p_y"))) + SLACK >= F.col("n") + F.col("n_y")
    met = enough & (F.col("n") >= F.col("n_y")) & (F.col("component") != F.col("component_y"))
    pairs = larger.where("other").join(smaller, ["h", "band"]).where(met).select(*_pair("node", "node_y"))
    rest = larger.where("not other").join(smaller.where("other_y"), ["h", "band"]).where(met).select(*_pair("node", "node_y"))
    return _gathered(pairs.union(rest).distinct())


def _fingerprint_pairs(classes: DataFrame, least: float) -> DataFrame:
    """Pairs ``a``, ``b`` of nodes whose fingerprints are equal or linked by the index of variants and whose sizes allow the similarity."""
    prints = checkpointed(classes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("r"), F.count("*").alias("c")))
    of = lambda c: prints.select(F.col("fp").alias(c), F.col("r.node").alias(f"node_{c}"), F.col("r.n").alias(f"n_{c}"))
    near = fingerprint_links(prints.select("fp")).join(of("a"), "a").join(of("b"), "b")
    same = classes.join(prints.where("c > 1").select("fp", F.col("r.node").alias("node_b"), F.col("r.n").alias("n_b")), "fp")
    columns = ["node_a", "n_a", "node_b", "n_b"]
    pairs = near.select(*columns).union(same.select(F.col("node").alias("node_a"), F.col("n").alias("n_a"), "node_b", "n_b"))
    can = F.least("n_a", "n_b") >= F.lit(least) * F.greatest("n_a", "n_b")
    return pairs.where(can & (F.col("node_a") != F.col("node_b"))).select(*_pair("node_a", "node_b"))


def _components(docs: DataFrame, prints: DataFrame, shingle: int, least: float) -> DataFrame:
    classes = prints.groupBy("node").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    indexed = _fingerprint_pairs(classes.select("node", "fp", "n"), least)
    index = classes.select(F.explode("keys").alias("key"), "node", "fp", "n")
    dealt = index.repartition("key").sortWithinPartitions("key")
    kinds = ", ".join(f"{c} long" for c in ("key", "node", "head", "members"))
    rows = checkpointed(dealt.mapInPandas(_buckets(least), kinds))
    pairs = rows.where("node != head").select(*_pair("node", "head"))
    pairs = _gathered(indexed.union(pairs).distinct())
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    links = _similar(pairs, _sets_of(nodes, docs, prints, shingle), least)
    part = _gathered(connected_components(links))
    known = rows.where("members > 2").join(part, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    known = checkpointed(known)
    mixed = known.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y")
    nodes = _gathered(known.join(mixed, "key", "left_semi").select("node").distinct())
    if not nodes.limit(1).count():
        return part
    sets = _sets_of(nodes, docs, prints, shingle)
    more = _across(_fronts(sets, part, least), least)
    if not more.limit(1).count():
        return part
    return _gathered(connected_components(links.union(_similar(more, sets, least))))


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group linked at the similarity, with the smallest ``doc_id`` (nulls last).

    All columns of ``docs`` are returned, whatever their names. Equal shingle
    sets are linked, those of null, empty and blank texts too. Of rows that share
    a group's smallest ``doc_id`` one stays, repeated rows among them; an empty
    table stays empty.
    """
    made = docs.select("doc_id", F.xxhash64("text").alias("hash"), _sketches(F.col("text"), shingle).alias("s"))
    prints = checkpointed(made.select("doc_id", "hash", "s.*"))
    part = _components(docs, prints, shingle, least)
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("hash").alias("h"))
    # the first of each set, then of each group: a large set leaves one row a task
    first = prints.groupBy("node").agg(F.min(order).alias("k"))
    keep = (
        first.join(part, "node", "left")
        .groupBy(F.coalesce("component", "node").alias("group"))
        .agg(F.min("k").alias("k"))
        .select(F.col("k.i").alias("__keep_id"), F.col("k.h").alias("__keep_hash"))
    )
    rows = prints.groupBy("doc_id", "hash").count()
    same = rows["doc_id"].eqNullSafe(keep["__keep_id"]) & (rows["hash"] == keep["__keep_hash"])
    rows = checkpointed(rows.join(keep, same, "left").select("doc_id", "hash", "count", F.col("__keep_hash").isNotNull().alias("stays")))
    drop = _sent(rows.where(~F.col("stays")).select(F.col("doc_id").alias("__id"), F.col("hash").alias("__gone")))
    mark = "__hash"
    while mark in {c.lower() for c in docs.columns}:
        mark += "_"
    marked = docs.withColumn(mark, F.xxhash64("text"))
    kept = marked.join(drop, marked["doc_id"].eqNullSafe(drop["__id"]) & (marked[mark] == drop["__gone"]), "left_anti")
    if rows.where("stays and count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", mark])
    return kept.select([F.col(f"`{c}`") for c in docs.columns])
