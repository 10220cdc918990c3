"""Packing, toxicity, embeddings, rules and SimHash against brute force, and with more tasks than rows."""

import zlib

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from verseloom.llm import embedding_dedup, packing, quality_model, quality_rules, simhash, toxicity
from verseloom.llm.components import Forest, connected_components, join_groups

WORDS = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_best_fit_equals_plain_choice(by):
    """The choice over all bins, one by one."""
    rng = np.random.default_rng(4)
    sizes, weights, whole = rng.integers(1, 90, 300).tolist(), (1.0, 0.5, 0.25), (100, 5, 6000)
    bins, offsets = packing.best_fit(sizes, *whole, weights, by)
    rooms, places = [], {}
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        size = (sizes[k], 1, min(sizes[k] ** 2, whole[2]))
        fit = [j for j, r in enumerate(rooms) if all(x >= y for x, y in zip(r, size))]
        if by == "norm":
            value = lambda j: sum(w * ((x - y) / c) ** 2 for w, x, y, c in zip(weights, rooms[j], size, whole))
        else:
            value = lambda j: -sum(w * x * y / c**2 for w, x, y, c in zip(weights, rooms[j], size, whole))
        if not fit:
            rooms.append(list(whole))
            fit = [len(rooms) - 1]
        j = min(fit, key=lambda j: (round(value(j), 12), j))
        places[k] = (j, whole[0] - rooms[j][0])
        rooms[j] = [x - y for x, y in zip(rooms[j], size)]
    assert max(bins) + 1 <= len(rooms) * 1.02 and sum(places[k] == (b, o) for k, (b, o) in enumerate(zip(bins, offsets))) >= 290


def test_weights_decide():
    """Where tokens tie or nearly tie, the other two resources choose the bin."""
    sizes = np.random.default_rng(8).integers(5, 60, 400).tolist()
    tokens, _ = packing.best_fit(sizes, 100, 5, 6000, (1.0, 0.0, 0.0))
    for weights in ((1.0, 0.0, 1.0), (1.0, 1.0, 0.0)):
        assert packing.best_fit(sizes, 100, 5, 6000, weights)[0] != tokens
    assert packing.best_fit(sizes)[0] != packing.best_fit(sizes, by="dot")[0]


def test_pieces_equal_plain_cuts(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    texts = ["", None, "one two three " * 9, "x", "Çédille. " * 40, "x", "a b " * 5000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in packing.pack(frame, WORDS).select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    want = []
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for p, s in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[s : s + 4096], "<u4")
            want.append((k, p, s, len(part), zlib.crc32(part.tobytes())))
    assert got == want


def _toxic_table(spark, parts):
    rows = [(k, f"plain words number {k}" + (" zorgblat" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(parts)
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


def test_toxicity_with_more_tasks_than_rows(spark):
    docs, labels = _toxic_table(spark, 200)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        model = toxicity.fit(docs, labels)
        few, one = toxicity.fit(docs.limit(0), labels), toxicity.fit(docs, labels.where("toxic = 0"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert few.score("zorgblat") == one.score("zorgblat") == 0
    assert model.score("a zorgblat") > 0.5 > model.score("plain words")
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert [x.start for x in got[3]["spans"]] == [len("plain words number 3 ")]
    assert got[4]["spans"] == []


def test_embedding_recall_and_clashing_hashes(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((250, 64))
    rows = np.concatenate([base + rng.standard_normal(base.shape) * s for s in (0.0, 0.1, 0.14, 0.16, 0.2)]).astype(np.float32)
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    n = (unit @ unit.T >= 0.98).sum(1) - 1
    frame = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(frame).collect()}
    assert sum(n) > 400 and sum(got.values()) >= 0.99 * sum(n) and all(got[k] <= n[k] for k in got)
    made = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "h1 long, h2 long")
    ids = [r["id"] for r in embedding_dedup.class_ids(made).collect()]
    assert len(set(ids)) == 4 and {1, 2} < set(ids)
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_repeats_are_judged_by_words(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdef"), 40)) for _ in range(30)] + ["", "a b", "a b c a b c"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def plain(text):
        w = text.split()
        at = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        return len({j for i, x in enumerate(at) if at.count(x) > 1 for j in (i, i + 1, i + 2)})

    for bits in (64, 3, 1):
        got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.measure(frame, bits).collect()}
        assert got == {k: plain(t) for k, t in enumerate(texts)}


def _fingerprint(text):
    words = [w for w in (text or "").encode().lower().split() if w]
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_from_text_to_component(spark):
    rng = np.random.default_rng(6)
    stock = [f"w{k}" for k in range(50)]
    texts = [" ".join(rng.choice(stock, 400)) for _ in range(12)]
    texts += [t + " tail" for t in texts[:6]] + [texts[0] + " tail more", "", None, "  ", "one", "ONE"]
    prints, forest = [_fingerprint(t) for t in texts], Forest()
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                forest.add(i, j)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame).collect()}
    assert [got[k]["fp"] % 2**64 for k in range(len(texts))] == prints
    assert [got[k]["component_id"] for k in range(len(texts))] == [forest.find(k) for k in range(len(texts))]


def test_clashing_and_dotted_names(spark):
    frame = spark.createDataFrame(
        [(k, t, 100 + k, k, k, k) for k, t in enumerate(["a b c d", "A b c d", "other words here", None])],
        "doc_id long, text string, __fp int, `a.b` int, __score int, __hash int",
    )
    for made in (simhash.deduplicate(frame), quality_model.filter_documents(frame, threshold=-1.0)):
        assert made.columns == frame.columns
        assert all(r["__fp"] == 100 + r["doc_id"] and r["a.b"] == r["doc_id"] for r in made.collect())


def test_hubs_and_long_chains(spark, monkeypatch):
    from verseloom.llm import components

    monkeypatch.setattr(components, "HOT", 3)
    edges = [(0, k) for k in range(1, 40)] + [(k, k + 1) for k in range(100, 160)] + [(39, 100), (7, 7), (None, 1)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(20)).collect()
    assert {r["node"]: r["component"] for r in got} == {k: 0 for k in [*range(40), *range(100, 161)]}
    rows = spark.createDataFrame([(k % 3 if k < 30 else k, k) for k in range(50)], "k int, v int")
    groups = rows.groupBy("k").agg(F.count("*").alias("c"), F.min("v").alias("m"))
    assert join_groups(rows, groups, "k").count() == 50
    monkeypatch.setattr(components, "SENT", 2)  # more keys than may be sent: those above the share are, fewer than SENT
    split = join_groups(rows, groups, "k", 50)
    assert split.count() == 50 and "c#" in split._jdf.queryExecution().toString() and "> 25" in split._jdf.queryExecution().toString()
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_very_long_text(spark):
    long = " ".join(f"word{k % 997}" for k in range(200_000))
    frame = spark.createDataFrame([(1, long), (2, long + " end"), (3, "x" * 1_000_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    assert packing.pack(frame, WORDS).agg(F.sum("length")).first()[0] > 400_000
    assert quality_rules.judge(frame).where("doc_id = 1").first()["n_words"] == 200_000


