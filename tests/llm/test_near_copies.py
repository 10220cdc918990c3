"""The pipeline's SimHash stage against all pairs at a Jaccard similarity of 0.8."""

import numpy as np

import corpus_pipeline
from verseloom.llm import near_copies
from verseloom.llm.components import Forest


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_stage_equals_all_pairs(spark):
    rng = np.random.default_rng(7)
    rows = []
    for group in range(25):
        base = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(20, 400)))]
        for _ in range(12):
            words = list(base)
            for at in rng.integers(0, len(words), int(rng.integers(0, 1 + len(words) // 40))):
                words[at] = f"x{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(1000, ""), (1001, None), (1002, "two words"), (1003, "two words"), (1004, "Two  Words"), (None, "no id"), (None, "other")]
    sets = [shingles(t) for _, t in rows]
    forest = Forest()
    wide = 0
    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or len(sets[i] & sets[j]) >= 0.8 * union:
                wide += union > 0 and len(sets[i] & sets[j]) < 0.9 * union
                forest.add(i, j)
    assert wide > 100
    docs = spark.createDataFrame([(k, t, "c") for k, t in rows], "doc_id long, text string, `a b` string").repartition(5)
    got = corpus_pipeline.simhash_dedup(spark, docs, "")
    assert got.columns == docs.columns
    want = [rows[i] for i in range(len(rows)) if forest.find(i) == i]
    found = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_names_nulls_repeats_and_empty_tables(spark):
    """Columns named like the stage's own come back as they were; repeated rows leave one."""
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, 7, "a"), (1, text, 7, "a"), (2, text + " end", 8, "b"), (3, None, 9, "c"), (4, None, 1, None), (None, "other words here", 2, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __hash long, __id string")
    got = sorted(map(tuple, near_copies.deduplicate(docs).collect()), key=str)
    assert got == sorted([rows[0], rows[3], rows[5]], key=str)
    assert near_copies.deduplicate(docs.limit(0)).count() == 0


def test_two_rows_of_a_bucket_are_compared_whatever_their_bits():
    far = np.array([0, 2**64 - 1], dtype=np.uint64)
    assert near_copies._heads(far, np.array([100, 100]), 0.8).tolist() in ([0, 0], [1, 1])
    assert near_copies._heads(far, np.array([100, 50]), 0.8).tolist() == [0, 1]


def test_fingerprints_within_the_index_are_linked_without_a_shared_band(spark):
    """The index of one-wildcard variants finds pairs by itself; the exact similarity still decides."""
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(f"y{k}" for k in range(300))]
    made = [near_copies.sketch(near_copies.shingles(t)) for t in texts]
    base = made[0][1]
    prints = [base, base ^ 0b1001 ^ 1 << 40, base ^ 0b110]  # the third is near by its bits alone
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [(k, m[0], fp, m[2], [100 * k + b for b in range(near_copies.BANDS)]) for k, (m, fp) in enumerate(zip(made, prints))]
    table = spark.createDataFrame(rows, "doc_id long, node long, fp long, n long, keys array<long>")
    table = table.join(docs.selectExpr("doc_id", "xxhash64(text) AS hash"), "doc_id")
    got = {r["node"]: r["component"] for r in near_copies._components(docs, table, 5, 0.8).collect()}
    assert got == {m[0]: min(made[0][0], made[1][0]) for m in made[:2]}
