"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a few differing bits.

Index: a fingerprint is cut into three segments, so two fingerprints at four or
fewer differing bits agree in one segment but for at most one bit. Each segment
is indexed once for every one of its bits with that bit deleted (64 variants a
fingerprint); an equality join on the variant finds every such pair, and the
full Hamming distance verifies it.

Distinct fingerprints are joined, never documents, so exact copies cost one
row. A bucket of the join puts out a spanning forest of its links, not all
pairs. Buckets above ``BLOCK`` fingerprints are cut into blocks that different
tasks take; links across blocks are then found by joining, within such a
bucket, the fingerprints outside its largest component to the whole bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verseloom.llm.common import checkpointed, serving
from verseloom.llm.components import Forest, connected_components, join_groups

SEED = 42
SHINGLE = 4
MAX_BITS = 4
SEGMENTS = ((0, 21), (21, 21), (42, 22))  # (lowest bit, width); the cover of MAX_BITS = 4
BLOCK = 20_000
ALL_PAIRS = 32  # buckets up to this size are compared pair by pair


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text as a signed 64-bit number; 0 for null, empty and blank texts."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        digest = xxhash.xxh64_intdigest
        hashes = np.array(
            [digest(joined[s:e], SEED) for s, e in zip((ends - sizes).tolist(), ends[shingle - 1 :].tolist())],
            dtype=np.uint64,
        )
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        serving("simhash")
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return prints(text)


def _variants(fp: Column) -> Column:
    """One key for each bit: its number, and its segment without it."""
    keys = []
    for low, width in SEGMENTS:
        segment = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            keys.append(segment.bitwiseAND(F.lit(~(1 << bit))) + F.lit((low + bit) << 22))
    return F.array(*keys)


def _link_large(prints: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """Edges with the components of a large bucket, by leaders: no list of all its pairs.

    Every fingerprint is linked to the first leader within ``max_bits``. Members
    of two leaders can be linked only if these are within three times that, and
    are compared only until the two groups turn out to be one component.
    """
    rest, leaders, members = np.arange(len(prints)), [], []
    while len(rest):
        near = np.bitwise_count(prints[rest] ^ prints[rest[0]]) <= max_bits
        leaders.append(rest[0])
        members.append(rest[near])
        rest = rest[~near]
    forest = Forest()
    for i, m in enumerate(members):
        yield from ((leaders[i], x) for x in m[1:].tolist())
    heads = prints[leaders]
    for i in range(len(leaders)):
        close = np.flatnonzero(np.bitwise_count(heads[i + 1 :] ^ heads[i]) <= 3 * max_bits) + i + 1
        for j in close.tolist():
            if forest.find(i) == forest.find(j):
                continue
            for x in members[i].tolist():
                hit = np.flatnonzero(np.bitwise_count(prints[members[j]] ^ prints[x]) <= max_bits)
                if len(hit):
                    forest.add(i, j)
                    yield x, members[j][hit[0]]
                    break


def _links(keys: np.ndarray, prints: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """Linked pairs of rows with equal keys; the rows come sorted by key."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
    sizes = ends - starts
    small = np.repeat(sizes <= ALL_PAIRS, sizes)
    for step in range(1, min(ALL_PAIRS, int(sizes.max(initial=1)))):
        same = (keys[:-step] == keys[step:]) & small[:-step]
        at = np.flatnonzero(same)
        at = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= max_bits]
        yield from zip(at.tolist(), (at + step).tolist())
    for k in np.flatnonzero(sizes > ALL_PAIRS).tolist():
        low = int(starts[k])
        yield from ((low + int(a), low + int(b)) for a, b in _link_large(prints[low : ends[k]], max_bits))


def _bucket_links(max_bits: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, held = Forest(), None
        for frame in frames:
            rows = frame[["key", "salt", "fp"]].to_numpy(dtype=np.int64)
            rows = rows if held is None else np.concatenate((held, rows))
            last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            done, held = rows[:cut], rows[cut:]
            yield _forest_rows(done, forest, max_bits)
        if held is not None:
            yield _forest_rows(held, forest, max_bits)

    return run


def _forest_rows(rows: np.ndarray, forest: Forest, max_bits: int) -> pd.DataFrame:
    found = []
    if len(rows) > 1:
        group = np.cumsum(np.concatenate(([0], (np.diff(rows[:, :2], axis=0) != 0).any(axis=1))))
        prints = rows[:, 2]
        for i, j in _links(group, prints.view(np.uint64), max_bits):
            if forest.add(int(prints[i]), int(prints[j])):
                found.append((int(prints[i]), int(prints[j])))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def fingerprint_links(prints: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Pairs ``a``, ``b`` of distinct fingerprints ``fp`` (long) within ``max_bits``: enough of them to connect all that links connect."""
    if max_bits > 2 * len(SEGMENTS) - 1:
        raise ValueError("three segments with one deleted bit cover at most 5 differing bits")
    # 64 rows a fingerprint: dealt out first, as a few tasks hold many of these short rows
    prints = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    index = prints.select("fp", F.explode(_variants(F.col("fp"))).alias("key"))
    values = F.array(
        *[
            F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << w) - 1)) + F.lit(low << 22)
            for low, w in SEGMENTS
        ]
    )
    # a bucket holds the prints of two segment values; only where one of these is frequent can it be large
    frequent = prints.select(F.explode(values).alias("v")).groupBy("v").count().where(F.col("count") > block // 2)
    hot = None
    if frequent.limit(1).count():
        sizes = index.groupBy("key").count().where(F.col("count") > block)
        hot = checkpointed(sizes.select("key", F.ceil(F.col("count") / block).alias("blocks")))
        index = index.join(hot, "key", "left").select(
            "fp", "key", F.expr("coalesce(pmod(xxhash64(fp), blocks), 0)").alias("salt")
        )
    else:
        index = index.withColumn("salt", F.lit(0).cast("long"))
    dealt = index.repartition("key", "salt").sortWithinPartitions("key", "salt")
    links = dealt.mapInPandas(_bucket_links(max_bits), "a long, b long")
    if hot is None:
        return links
    links = checkpointed(links)
    part = connected_components(links)
    return links.union(_links_across(prints, hot, part, max_bits))


def link_fingerprints(prints: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Components of distinct fingerprints ``fp`` (long): ``node``, ``component``; unlinked ones are absent."""
    return connected_components(fingerprint_links(prints, max_bits, block))


def _links_across(prints: DataFrame, hot: DataFrame, part: DataFrame, max_bits: int) -> DataFrame:
    """Links between different components inside the large buckets."""
    known = prints.join(part, prints["fp"] == part["node"], "left").select(
        "fp", F.coalesce("component", "fp").alias("component")
    )
    rows = known.select("fp", "component", F.explode(_variants(F.col("fp"))).alias("key"))
    salt = F.expr("pmod(xxhash64(fp), blocks)")
    rows = checkpointed(rows.join(hot, "key").withColumn("salt", salt))
    largest = (
        rows.groupBy("key", "component").count().groupBy("key").agg(F.max_by("component", "count").alias("largest"))
    )
    others = rows.join(largest, "key").where("component != largest")
    # each of these goes to all blocks of its bucket, so that no bucket is one task's
    others = others.select(
        "key", F.col("fp").alias("a"), F.col("component").alias("of_a"), F.explode(F.expr("sequence(0l, blocks - 1)")).alias("salt")
    )
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= max_bits
    found = others.join(rows, ["key", "salt"]).where((F.col("of_a") != F.col("component")) & near)
    return found.select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """One row a document: ``doc_id``, ``fp`` (signed long) and ``component_id``.

    ``component_id`` is the smallest ``doc_id`` among the documents it reaches
    by links. Null, empty and blank texts have fingerprint 0 and are linked like
    others; repeated rows stay; a null ``doc_id`` is never the smallest unless
    the component has no other; an empty table gives an empty result. Other
    columns of ``docs`` are not read.
    """
    prints = checkpointed(docs.select(F.col("doc_id"), fingerprint_column(F.col("text"), shingle).alias("fp")))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = checkpointed(link_fingerprints(classes.select("fp"), max_bits, block))
    joined = classes.join(parts, classes["fp"] == parts["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    groups = joined.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("c"))
    named = join_groups(joined, groups, "component", prints.count()).select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, with the smallest ``doc_id`` (nulls last).

    All columns of ``docs`` are returned, whatever their names. Rows that share
    the smallest ``doc_id`` are taken by smallest fingerprint, one of them. Null,
    empty and blank texts are copies of each other; an empty table stays empty.
    """
    found = near_duplicates(docs, shingle, max_bits)
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("fp").alias("f"))
    # a component is named by its smallest id; those with null ids alone by their smallest fingerprint
    keep = (
        found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone"))
        .agg(F.min(order).alias("k"))
        .select(F.col("k.i").alias("keep_id"), F.col("k.f").alias("keep_fp"))
    )
    # the row itself is one column, so that none of its names can clash
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"))
    marked = marked.withColumn("own_fp", fingerprint_column(F.col("row.text"), shingle))
    same = F.col("own_id").eqNullSafe(F.col("keep_id")) & (F.col("own_fp") == F.col("keep_fp"))
    return marked.join(keep, same, "left_semi").dropDuplicates(["own_id", "own_fp"]).select("row.*")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
