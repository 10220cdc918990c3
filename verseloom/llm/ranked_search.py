"""Ranked lexical search by the Best Position Algorithm over impact lists.

Documents are dealt out in blocks. A block has, for each asked term, a list of
its documents by falling impact (the term's part of a score), and a table that
tells where in each list a document stands. For each item the algorithm reads
the lists from their best position on (the end of the part whose positions are
all known, be it by reading the list or by a direct access), looks a new document
up in all other lists, and stops once the impacts at the first unknown positions
add up to strictly less than the k-th score: no unknown document can reach or tie
it. What a task has found so far bounds its later blocks too.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from verseloom.llm.common import checkpointed

TOP = 10
TERMS = 100_000  # terms of items that one pass over the documents looks for, about
CELLS = 8_000_000  # documents of a block times terms, at most (four bytes each)
STEP = 16  # positions that a first round reads of each list; later ones read more
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of the bytes of UTF-8: digits and a-z stay, A-Z become a-z, what lies above U+007F stays, all else divides terms.
BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).translate(
    bytes.maketrans(UPPER.encode(), LOWER.encode())
)


def terms_of(text: Column) -> Column:
    """Terms of a text in order, repeats included; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))


def count_terms(docs: DataFrame, index: dict[bytes, int]) -> DataFrame:
    """``doc_id``, ``n`` (all terms), ``at`` (numbers of the indexed terms that occur) and ``tf`` of each document with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, ends, at, tf = [], [], [0], [], []
            for k, value in enumerate(batch.column(1)):
                words = (value.as_py() or b"").translate(BYTES).split()
                if words:
                    found = Counter(filter(index.__contains__, words))
                    rows.append(k)
                    sizes.append(len(words))
                    at += map(index.__getitem__, found)
                    tf += found.values()
                    ends.append(len(at))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (at, tf)]
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "at", "tf"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where("text is not null")
    return rows.mapInArrow(run, f"doc_id {kind}, n long, at array<int>, tf array<int>")


class Block:
    """The impact lists of some documents. Place 0 stands for "not in the list" and has impact 0."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, order: np.ndarray, terms: int) -> None:
        by = np.lexsort((order[doc], -impact, term))
        self.doc = np.concatenate(([-1], doc[by]))
        self.impact = np.concatenate(([0], impact[by]))
        ends = np.cumsum(np.bincount(term, minlength=terms)) + 1
        self.first, self.end = np.concatenate(([1], ends[:-1])), ends
        self.where = np.zeros((len(order), terms), dtype=np.int32)
        self.where[doc[by], term[by]] = np.arange(1, len(by) + 1)
        self.seen = np.zeros(len(by) + 2, dtype=bool)

    def search(self, terms: np.ndarray, k: int, kth: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of the block that may be among the ``k`` best, with their scores; only scores above 0 and not below ``kth``."""
        terms = terms[self.end[terms] > self.first[terms]]
        at, end = self.first[terms].copy(), self.end[terms]
        known = np.zeros(len(self.where), dtype=bool)
        docs, scores, marked, step = [], [], [], STEP
        best = np.zeros(0, dtype=np.int64)
        ahead = np.arange(64)
        while True:
            # the first position of each list that isn't known
            while True:
                run = at[:, None] + ahead
                run = (self.seen[np.minimum(run, len(self.seen) - 1)] & (run < end[:, None])).cumprod(axis=1).sum(axis=1)
                at = at + run
                if not (run == len(ahead)).any():
                    break
            threshold = int(self.impact[at[at < end]].sum())
            if threshold == 0 or threshold < kth:
                break
            places = at[:, None] + np.arange(step)
            new = np.unique(self.doc[places[places < end[:, None]]])
            new = new[~known[new]]
            known[new] = True
            found = self.where[new[:, None], terms]  # direct accesses to all lists
            self.seen[found] = True
            self.seen[0] = False
            marked.append(found)
            score = self.impact[found].sum(axis=1)
            docs.append(new)
            scores.append(score)
            best = np.concatenate((best, score))
            if len(best) >= k:
                best = np.partition(best, len(best) - k)[len(best) - k :]
                kth = max(kth, int(best.min()))
            step = min(2 * step, 1024)
        for found in marked:
            self.seen[found] = False
        if not docs:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        chosen = (scores > 0) & (scores >= kth)
        return docs[chosen], scores[chosen]


def _ranked(pairs: list[tuple[int, object]], k: int) -> list[tuple[int, object]]:
    """Scores and ids, the highest first, equal scores by ascending id (null last)."""
    return sorted(pairs, key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))[:k]


def block_best(items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int, cells: int = CELLS):
    """The work of a task: the ``k`` best of its documents for each item, as ``item`` (number), ``score`` and ``doc_id``."""
    weights, size = weights.astype(np.int64), max(1, cells // max(1, len(weights)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list] = [[] for _ in items]
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for low in range(0, batch.num_rows, size):
                part = batch.slice(low, size)
                ids = part.column(0).to_pylist()
                at, tf = part.column(2), part.column(3)
                n = part.column(1).to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(ids)), at.value_lengths().to_numpy(zero_copy_only=False))
                term, tf = at.flatten().to_numpy(), tf.flatten().to_numpy().astype(np.int64)
                m = 10 + (90 * n * n_docs) // n_terms
                impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                order = np.empty(len(ids), dtype=np.int64)
                order[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))] = np.arange(len(ids))
                block = Block(doc, term, impact, order, len(weights))
                for i, terms in enumerate(items):
                    kth = kept[i][-1][0] if len(kept[i]) == k else 0
                    docs, scores = block.search(terms, k, kth)
                    if len(docs):
                        best = np.lexsort((order[docs], -scores))[:k]
                        kept[i] = _ranked(kept[i] + [(int(scores[b]), ids[docs[b]]) for b in best], k)
        if kind is not None:
            rows = [(i, s, d) for i, best in enumerate(kept) for s, d in best]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], kind)], ["item", "score", "doc_id"]
            )

    return run


def _asked(items: DataFrame, bound: int) -> tuple[DataFrame, int]:
    """Distinct ``item_id``, ``term`` and the number of passes that keep each pass to about ``bound`` of them, or to one item."""
    asked = checkpointed(items.select("item_id", F.explode(terms_of(F.col("text"))).alias("term")).distinct())
    passes = max(1, -(-asked.count() // bound))
    while passes > 1:
        part = F.pmod(F.xxhash64("item_id"), F.lit(passes))
        per_item = asked.groupBy("item_id", part.alias("p")).agg(F.count("*").alias("c"))
        crowded = per_item.groupBy("p").agg(F.sum("c").alias("c"), F.count("*").alias("n")).where((F.col("c") > 2 * bound) & (F.col("n") > 1))
        if crowded.isEmpty():
            break
        passes *= 2
    return asked, passes


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, bound: int = TERMS) -> DataFrame:
    """The ``k`` best of all ``docs(doc_id, text)`` for each of ``items(item_id, text)``: ``item_id``, ``rank``, ``doc_id``, ``score``.

    A term's weight is floor(1000 ln((2N+2) / (2df+1))); it adds the weight times
    (10^9 tf) div (1000 tf + 8m), with m = 10 + (90 n N) div L. Each pass holds
    about ``bound`` terms of items; more items are asked in more passes over the
    documents, so nothing that grows is sent to the executors. A task gives out
    ``k`` rows an item at most.

    Null and empty texts hold no term. Each row of ``docs`` is a document, so
    repeated rows come repeatedly, and null ids come after others of their score.
    Rows with equal ``item_id`` (null too) are one item with the terms of all.
    Items without a hit, and an empty table, give no row. Other columns are not
    read.
    """
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType.simpleString()
    asked, passes = _asked(items, bound)
    out = None
    for p in range(passes):
        mine = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p)
        terms: dict[str, int] = {}
        by_item: dict[object, list[int]] = {}
        for row in mine.collect():
            by_item.setdefault(row["item_id"], []).append(terms.setdefault(row["term"], len(terms)))
        counted = checkpointed(count_terms(docs, {t.encode(): i for t, i in terms.items()}))
        n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs or not terms:
            continue
        df = {r["at"]: r["count"] for r in counted.select(F.explode("at").alias("at")).groupBy("at").count().collect()}
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(terms))])
        lists = [np.array(sorted(x), dtype=np.int64) for x in by_item.values()]
        id_type = docs.schema["doc_id"].dataType.simpleString()
        best = counted.where(F.size("at") > 0).mapInArrow(
            block_best(lists, weights, n_docs, n_terms, k), f"item int, score long, doc_id {id_type}"
        )
        schema = StructType([StructField("item", LongType()), StructField("item_id", items.schema["item_id"].dataType)])
        names = spark.createDataFrame(list(enumerate(by_item)), schema)  # the items of a pass
        w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        part = top.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = part if out is None else out.union(part)
    if out is None:
        id_type = docs.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {id_type}, score long")
    return out


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')"

OP13_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
sized AS (SELECT r, doc_id, len(ts)::BIGINT AS n, ts FROM docs WHERE len(ts) > 0),
total AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM sized),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
words AS (SELECT r, doc_id, n, unnest(ts) AS t FROM sized),
tf AS (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM words SEMI JOIN asked USING (t) GROUP BY ALL),
weight AS (SELECT t, floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY t),
scored AS (SELECT item_id, r, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // nt))))::BIGINT AS score
  FROM asked JOIN tf USING (t) JOIN weight USING (t), total GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}"""
