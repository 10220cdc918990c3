"""Embedding near-duplicates: random-hyperplane signatures in several tables, exact cosines, components.

Exact copies are one class, and classes are compared. A class has one signature;
each table cuts its own bits of it, and classes that agree in a table's bits and
label meet in a bucket. First only ids and signatures are dealt to the buckets:
a pair that meets is a candidate if its signatures differ in few bits, in the
first of its common tables only. Then the vectors of the classes with a candidate
go to those buckets, and there every pair gets its exact cosine. A bucket puts
out numbers per class and a spanning forest of its links, never its pairs.
Buckets above ``BLOCK`` classes are cut into blocks, and each pair of blocks is a
group of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verseloom.llm.common import checkpointed
from verseloom.llm.components import Forest, connected_components, join_groups

MIN_COSINE = 0.98
MISSED = 1e-3  # chance that a pair at MIN_COSINE meets in no table
BUCKET = 32  # vectors a bucket would hold if their signs were even
BLOCK = 2_000
SENT = 200_000  # classes up to which the ids of those with candidates go to each executor
CARRIED = 2  # words of a signature that go to the buckets
ESTIMATE = 16  # one class of so many tells how full a bucket is; only the number of blocks depends on it
STEPS = 64  # buckets up to this size are compared together
SEED = 42


def plan(n: int, min_cosine: float = MIN_COSINE, missed: float = MISSED) -> tuple[int, int]:
    """Bits of a table for ``n`` vectors, and tables: as many as keep the chance to miss a pair below ``missed``."""
    bits = max(6, min(30, math.ceil(math.log2(max(2, n / BUCKET)))))
    meet = (1 - math.acos(min_cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(missed) / math.log1p(-meet))


def wide(size: int, min_cosine: float, missed: float) -> int:
    """Bits of ``size`` in which a pair at ``min_cosine`` differs, but for a chance of ``missed``."""
    p, tail = math.acos(min_cosine) / math.pi, 1.0
    for k in range(size + 1):
        tail -= math.comb(size, k) * p**k * (1 - p) ** (size - k)
        if tail <= missed:
            return k
    return size


def _usable(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & ~bad & F.exists(embedding, lambda x: x != 0)


def _signer(bits: int, tables: int, seed: int):
    """The signature in words; a word holds the bits of as many whole tables as fit."""
    planes: dict[int, np.ndarray] = {}
    each = 64 // bits
    words = -(-tables // each)

    @F.pandas_udf("array<long>")
    def sign(vectors: pd.Series) -> pd.Series:
        out = np.empty(len(vectors), dtype=object)
        sizes = vectors.map(len).to_numpy()
        for dim in np.unique(sizes):
            if dim not in planes:
                planes[dim] = np.random.default_rng(seed).standard_normal((tables * bits, dim)).T
            at = np.flatnonzero(sizes == dim)
            block = np.stack(vectors.iloc[at].to_list()).astype(np.float64)
            side = (block / np.abs(block).max(axis=1, keepdims=True)) @ planes[dim] > 0
            side = side.reshape(len(at), tables, bits) @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))
            got = np.zeros((len(at), words), dtype=np.uint64)
            for t in range(tables):
                got[:, t // each] |= side[:, t].astype(np.uint64) << np.uint64(t % each * bits)
            for k, row in zip(at, got.view(np.int64)):
                out[k] = row
        return pd.Series(out)

    return sign


def _keys(words: Column, bits: int, tables: int) -> Column:
    each = 64 // bits
    part = lambda t: F.shiftrightunsigned(F.get(words, F.lit(t // each)), t % each * bits)
    return F.array(*[part(t).bitwiseAND(F.lit((1 << bits) - 1)) for t in range(tables)])


def _met_before(a: np.ndarray, b: np.ndarray, t: np.ndarray, bits: int) -> np.ndarray:
    """Whether two signatures (rows of words) agree in a table before ``t``, as far as the words tell."""
    each, mask = 64 // bits, np.uint64((1 << bits) - 1)
    met = np.zeros(len(a), dtype=bool)
    for k in range(min(int(t.max(initial=0)), each * a.shape[1])):
        other = (a[:, k // each] ^ b[:, k // each]) >> np.uint64(k % each * bits)
        met |= ((other & mask) == 0) & (k < t)
    return met


def _groups(columns: list[str], done):
    """Runs ``done(rows)`` on all whole groups of a sorted task; ``rows`` maps names to arrays, groups not cut."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            new = {c: frame[c].to_numpy() for c in frame.columns}
            rows = new if held is None else {c: np.concatenate((held[c], new[c])) for c in new}
            if not len(rows["id"]):
                continue
            other = np.zeros(len(rows["id"]), dtype=bool)
            for c in columns:
                other |= rows[c] != rows[c][-1]
            cut = np.flatnonzero(other)
            cut = int(cut[-1]) + 1 if len(cut) else 0
            if cut:
                yield from done({c: x[:cut] for c, x in rows.items()})
            held = {c: x[cut:] for c, x in rows.items()}
        if held is not None and len(held["id"]) > 1:
            yield from done(held)

    return run


def _starts(rows: dict[str, np.ndarray], columns: list[str]) -> np.ndarray:
    new = np.zeros(len(rows["id"]), dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= rows[c][1:] != rows[c][:-1]
    return np.append(np.flatnonzero(new), len(new))


def _candidates(bits: int, limit: int):
    """Of each bucket the classes with a candidate partner that they meet in it first."""
    group = ["bucket", "i", "j"]

    def done(rows: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        words = np.stack([rows[c].view(np.uint64) for c in rows if c.startswith("w")], axis=1)
        starts = _starts(rows, group)
        sizes = np.diff(starts)
        of, live = np.repeat(np.arange(len(sizes)), sizes), np.zeros(len(words), dtype=bool)

        def mark(p: np.ndarray, q: np.ndarray) -> None:
            near = np.bitwise_count(words[p] ^ words[q]).sum(axis=1, dtype=np.int64) <= limit
            p, q = p[near], q[near]
            new = ~_met_before(words[p], words[q], rows["t"][p], bits)
            live[p[new]] = live[q[new]] = True

        small = (sizes <= STEPS)[of]
        for step in range(1, int(sizes[sizes <= STEPS].max(initial=1))):
            p = np.flatnonzero((of[:-step] == of[step:]) & small[:-step])
            both = (rows["block"][p] == rows["i"][p]) & (rows["block"][p + step] == rows["j"][p])
            both |= (rows["block"][p] == rows["j"][p]) & (rows["block"][p + step] == rows["i"][p])
            mark(p[both], p[both] + step)
        for k in np.flatnonzero(sizes > STEPS).tolist():
            at = np.arange(starts[k], starts[k + 1])
            own = at[rows["block"][at] == rows["i"][at[0]]]
            other = at[rows["block"][at] == rows["j"][at[0]]]
            for x in own.tolist():
                mate = other[other > x] if rows["i"][at[0]] == rows["j"][at[0]] else other
                mark(np.full(len(mate), x), mate)
        yield pd.DataFrame({c: rows[c][live] for c in ("bucket", "t", "id")}).drop_duplicates()

    return _groups(group, done)


class _Found:
    """Numbers of links by class, and forest edges, of the buckets of one batch."""

    def __init__(self) -> None:
        self.a, self.b, self.links = [], [], []

    def frame(self) -> pd.DataFrame:
        out = pd.DataFrame({"a": self.a, "b": self.b, "links": self.links}, dtype="int64")
        self.__init__()
        return out


def _compare(rows: dict[str, np.ndarray], bits: int, min_cosine: float, forest: Forest, found: _Found) -> None:
    """Links of one bucket, or between two blocks of one. Vectors of different lengths have no cosine."""
    left, right = rows["i"][0], rows["j"][0]
    ids, size, block = rows["id"], rows["n"], rows["block"]
    words = np.stack(rows["s"]).view(np.uint64)
    dims = np.fromiter(map(len, rows["v"]), np.int64, len(ids))
    links = np.zeros(len(ids), dtype=np.int64)
    for dim, label in {*zip(dims.tolist(), rows["label_id"].tolist())}:
        at = np.flatnonzero((dims == dim) & (rows["label_id"] == label))
        if len(at) < 2:
            continue
        unit = np.stack(rows["v"][at]).astype(np.float64)
        unit /= np.abs(unit).max(axis=1, keepdims=True)
        unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        own, other = np.flatnonzero(block[at] == left), np.flatnonzero(block[at] == right)
        for x in range(0, len(own), 256):
            p, q = np.nonzero(unit[own[x : x + 256]] @ unit[other].T >= min_cosine)
            p, q = own[x : x + 256][p], other[q]
            if left == right:
                p, q = p[p < q], q[p < q]
            p, q = at[p], at[q]
            new = ~_met_before(words[p], words[q], rows["t"][p], bits)
            p, q = p[new], q[new]
            np.add.at(links, p, size[q])
            np.add.at(links, q, size[p])
            for m, n in zip(ids[p].tolist(), ids[q].tolist()):
                if forest.add(m, n):
                    found.a.append(m)
                    found.b.append(n)
                    found.links.append(0)
    some = np.flatnonzero(links)
    found.a += ids[some].tolist()
    found.b += ids[some].tolist()
    found.links += links[some].tolist()


def _links(bits: int, min_cosine: float):
    group = ["bucket", "i", "j"]
    forest, found = Forest(), _Found()

    def done(rows: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        starts = _starts(rows, group)
        for low, high in zip(starts.tolist(), starts[1:].tolist()):
            if high - low > 1:
                _compare({c: x[low:high] for c, x in rows.items()}, bits, min_cosine, forest, found)
        yield found.frame()

    return _groups(group, done)


def class_ids(classes: DataFrame) -> DataFrame:
    """``classes(h1, h2, ...)``, unique in both hashes together, with an ``id`` of 64 bits that no two share."""
    clash = checkpointed(classes.groupBy("h1").agg(F.count("*").alias("c"), F.min("h2").alias("first")).where("c > 1"))
    if not clash.limit(1).count():
        return classes.withColumn("id", F.col("h1"))
    own = F.when(F.coalesce(F.col("h2") == F.col("first"), F.lit(True)), F.col("h1")).otherwise(F.xxhash64("h1", "h2"))
    return classes.join(clash.select("h1", "first"), "h1", "left").withColumn("id", own).drop("first")


def _blocked(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows of buckets once for each pair of blocks that they are part of; ``hot(bucket, blocks)`` names those of several."""
    rows = rows.join(hot, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda x: F.struct(F.least(x, "block").alias("i"), F.greatest(x, "block").alias("j")),
    )
    return rows.withColumn("p", F.explode(pairs)).select("*", "p.i", "p.j").drop("p", "blocks")


def _hot(counts: DataFrame, block: float) -> DataFrame:
    """Buckets above ``block`` rows: at most all rows divided by it, and sent to the executors only while they are few."""
    hot = checkpointed(counts.where(F.col("count") > block).select("bucket", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    return F.broadcast(hot) if hot.count() <= SENT else hot


def near_duplicates(
    vectors: DataFrame, min_cosine: float = MIN_COSINE, missed: float = MISSED, block: int = BLOCK, seed: int = SEED
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of each row of ``vectors(vec_id, embedding, label)``.

    Vectors are compared if their labels are equal and not null; of the pairs at
    ``min_cosine`` or more all but a share of ``missed`` are found, and of those
    below none. Vectors that are null, empty, zero or hold null or non-finite
    components, and those without a label, have no links. Rows with a null id
    count as links of others but name no component unless it has no other id.
    Repeated rows are copies of each other. An empty table gives an empty result.
    Other columns are not read. Copies and labels are told by hashes of 128 and
    64 bits.
    """
    plain = vectors.schema["embedding"].dataType.elementType.simpleString()
    v = F.col("embedding") if plain in ("float", "double") else F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", "label", v.alias("v")).withColumn(
        "ok", F.coalesce(_usable(F.col("v")), F.lit(False)) & F.col("label").isNotNull()
    )
    single = rows.where(~F.col("ok")).select(
        "vec_id",
        F.lit(0).cast("long").alias("n_links"),
        F.col("vec_id").alias("component_id"),
        F.lit(True).alias("kept"),
    )
    label = F.col("label").cast("string")
    rows = rows.where("ok").select(
        "vec_id", "v", F.xxhash64(label, "v").alias("h1"), F.xxhash64(F.lit(seed), label, "v").alias("h2"), F.xxhash64(label).alias("label_id")
    )
    bits, tables = plan(vectors.count(), min_cosine, missed)
    # a class is all copies of one vector under one label
    classes = rows.select("vec_id", "h1", "h2", "label_id", _signer(bits, tables, seed)("v").alias("s")).groupBy("h1", "h2").agg(
        F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("label_id").alias("label_id"), F.first("s").alias("s")
    )
    classes = checkpointed(class_ids(checkpointed(classes)))
    each = 64 // bits
    carried = min(CARRIED, -(-tables // each))
    limit = wide(bits * min(tables, carried * each), min_cosine, missed / 1000)
    met = classes.select(
        "id", "label_id", *[F.get("s", F.lit(k)).alias(f"w{k}") for k in range(carried)], F.posexplode(_keys(F.col("s"), bits, tables)).alias("t", "key")
    )
    met = met.withColumn("bucket", F.xxhash64("label_id", "t", "key")).drop("label_id", "key")
    share = ESTIMATE if block >= 16 * ESTIMATE else 1
    counts = met.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).groupBy("bucket").count()
    keys = ["bucket", "i", "j"]
    dealt = _blocked(met, _hot(counts.withColumn("count", F.col("count") * share), block))
    live = checkpointed(
        dealt.repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInPandas(_candidates(bits, limit), "bucket long, t int, id long")
        .distinct()
    )
    ids = live.select("id").distinct()
    chosen = checkpointed(classes.join(ids, "id", "left_semi").select("h1", "h2", "id", "label_id", "n", "s", "least"))
    sent = F.broadcast(chosen.select("h1", "h2", "least")) if chosen.count() <= SENT else chosen.select("h1", "h2", "least")
    one = rows.select("vec_id", "h1", "h2", "v").join(sent, ["h1", "h2"]).where(F.col("vec_id").eqNullSafe(F.col("least")))
    one = one.groupBy("h1", "h2").agg(F.first("v").alias("v"))  # where rows repeat
    full = chosen.drop("least").join(one, ["h1", "h2"]).drop("h1", "h2").join(live, "id")
    full = _blocked(full, _hot(live.groupBy("bucket").count(), block))
    found = checkpointed(
        full.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_links(bits, min_cosine), "a long, b long, links long")
    )
    links = found.where("links > 0").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("links = 0").select("a", "b"))
    known = classes.join(links, "id", "left").join(parts, F.col("id") == F.col("node"), "left")
    known = checkpointed(
        known.select(
            "h1",
            "h2",
            "least",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"),
            F.coalesce("component", "id").alias("component"),
        )
    )
    named = known.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("c"))
    by_vector = join_groups(known, named, "component", known.count()).select("h1", "h2", "n_links", "component_id")
    linked = rows.select("vec_id", "h1", "h2").join(by_vector, ["h1", "h2"]).select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
    return linked.union(single)


def op7_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND list_cosine_similarity(a.e, b.e) >= {MIN_COSINE}),
reach AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.c = l.a),
least AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, least.component_id, e.vec_id = least.component_id AS kept
FROM embeddings e JOIN least ON least.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""
