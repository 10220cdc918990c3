"""Ranked search against SQL on the given tables and against plain scores on odd ones."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from verseloom.llm import ranked_search as rs


def plain(docs, items, k=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    tokens = [(i, Counter(words(t))) for i, t in docs]
    tokens = [(i, c, sum(c.values())) for i, c in tokens if c]
    n, total = len(tokens), sum(s for _, _, s in tokens)
    df = Counter(w for _, c, _ in tokens for w in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c, s in tokens:
            m = 10 + 90 * s * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def rows(frame):
    return sorted(map(tuple, frame.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("bound", [rs.TERMS, 300])
def test_equals_sql(spark, bound):
    """All items in one pass, and in several."""
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = rs.ranked_search(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"), bound=bound)
    assert rows(got) == sorted(db.sql(rs.OP13_SQL).fetchall(), key=repr)


def test_odd_tables(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["Alpha", "beta", "été", "ÉTÉ", "x1", "日本", "a_b", "gamma-delta", "K", "!"]
    docs = [(int(i), " ".join(rng.choice(vocabulary, rng.integers(0, 9)))) for i in range(60)]
    docs += [(5, "alpha beta"), (5, "alpha beta"), (None, "alpha beta"), (None, None), (7, ""), (8, "?!"), (9, "beta " * 50_000)]
    items = [(1, "ALPHA beta"), (1, "x1"), (None, "été b"), (3, None), (4, ""), (5, "nowhere"), (6, "日本 k K"), (7, "beta " * 1000)]
    frame = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, text string, score long").repartition(5)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    assert rows(rs.ranked_search(frame, asked)) == plain(docs, items)
    assert rows(rs.ranked_search(frame, asked, k=2)) == plain(docs, items, 2)
    assert rs.ranked_search(frame.limit(0), asked).count() == 0
    assert rs.ranked_search(frame, asked.limit(0)).count() == 0


def test_reads_less_than_all_and_stops_strictly_below():
    """A block whose best documents lead all lists is left early; ties with the k-th score are still found."""
    n, terms = 5000, 3
    doc, term = np.tile(np.arange(n), terms), np.repeat(np.arange(terms), n)
    impact = np.where(doc < 20, 1000, 5).astype(np.int64)
    block = rs.Block(doc, term, impact, np.arange(n), terms)
    docs, scores = block.search(np.arange(terms), 10, 0)
    assert sorted(docs.tolist()) == list(range(20)) and set(scores.tolist()) == {3000}
    assert len(block.search(np.arange(terms), 10, 3001)[0]) == 0 and not block.seen.any()


def test_best_positions_pass_what_direct_accesses_saw():
    """Documents seen in one list move the best position of the others, so fewer positions are read."""
    rng = np.random.default_rng(2)
    n = 400
    doc, term = np.tile(np.arange(n), 4), np.repeat(np.arange(4), n)
    for _ in range(20):
        impact = rng.integers(1, 60, 4 * n)
        block = rs.Block(doc, term, impact, np.arange(n), 4)
        docs, scores = block.search(np.arange(4), 7, 0)
        whole = np.bincount(doc, impact, minlength=n).astype(int)
        kth = np.sort(whole)[-7]
        assert sorted(docs[scores >= kth].tolist()) == np.flatnonzero(whole >= kth).tolist()
