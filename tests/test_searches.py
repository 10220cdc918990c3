"""Searches for many requests at once against plain readings of their definitions, and how much of them goes through shuffles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verseloom.operators import ingest, needles, outline, search, shared, survey, texts


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def sample(spark, n=80, seed=3):
    rng = random.Random(seed)
    words = ["alpha", "beta", "Été", "gamma", "al", "phabet", "x-ray", "to be", "a"]
    rows = [(k % 9, k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 7)))) for k in range(n)]
    rows += [(90, 0, None), (91, 0, "")]
    return rows, frame(spark, [(d, "en", p, t) for d, p, t in rows], "doc_id long, lang string, pos int, segment string").repartition(6)


@pytest.mark.parametrize("letters", [needles.LETTERS, 10])
def test_needles_in_one_or_more_passes(spark, letters):
    rows, table = sample(spark)
    asked = ["alpha", "pha", "a b", "é", "zzz", "", None, "be"]
    found = needles.needle_hits(table, {"segment": F.col("segment"), "lang": F.col("lang")}, frame(spark, [(x,) for x in asked], "needle string"), letters)
    got = sorted((r.doc_id, r.pos, r.needle, r.field) for r in found.collect())
    assert got == sorted((d, p, n, "segment") for d, p, t in rows for n in asked if n and t and n in t)
    assert needles.needle_hits(table, {"segment": F.col("segment")}, frame(spark, [], "needle string")).count() == 0


def test_tables_of_requests(spark):
    rows, table = sample(spark)
    asked = [(1, " ALPHA "), (2, "al"), (3, None), (4, "ete"), (5, "alpha"), (6, "en")]
    got = needles.search_substrings(table, frame(spark, asked, "request_id int, needle string"), ["segment", "lang"], ["doc_id", "pos"], 4).collect()
    plain = lambda t: (t or "").lower().replace("é", "e")
    for request, needle in ((1, "alpha"), (4, "ete"), (5, "alpha")):
        want = sorted((d, p) for d, p, t in rows if needle in plain(t))[:4]
        assert [(r.doc_id, r.pos) for r in sorted(got, key=lambda r: r.rank) if r.request_id == request] == want
    assert {r.request_id for r in got} == {1, 4, 5}
    queries = [(1, "the gamma-xx"), (2, "be"), (3, "  "), (4, None), (5, "BETA beta")]
    hits = needles.match_any_tokens(table, frame(spark, queries, "request_id int, query string"), ["segment"], ["doc_id", "pos"]).collect()
    for request, tokens in ((1, ["the", "gamma"]), (2, ["be"]), (5, ["beta"])):
        want = sorted((d, p) for d, p, t in rows if any(x in (t or "").lower() for x in tokens))
        assert sorted((r.doc_id, r.pos) for r in hits if r.request_id == request) == want
    assert {r.request_id for r in hits} == {1, 2, 5}


def test_many_terms_equal_few(spark, monkeypatch):
    """The way by the vocabulary, with hot tokens split, finds what the way by broadcast terms does."""
    _, table = sample(spark)
    terms = survey.term_table(spark, [("alpha", "word"), ("alpha", "stem"), ("a", "stem"), ("Été", "word"), ("to be", "word"), ("none", "stem"), ("", "stem")])
    few = survey.term_hits(table, terms)
    monkeypatch.setattr(shared, "HOT_KEYS", 10_000)
    many = survey.term_hits(table, terms, few=0)
    columns = ["term", "scope", "doc_id", "pos"]
    assert sorted(few.select(*columns).collect()) == sorted(many.select(*columns).collect()) and few.count() > 50
    assert "__part" in many._jdf.queryExecution().toString()


def test_parts_of_words(spark):
    words = ["alphabet", "alpha", "phalanx", "beta", "a", "ab", "abab", "x"]
    table = frame(spark, [(w,) for w in words], "token string")
    parts = ["alpha", "pha", "a", "ab", "bab", "zz", "phx", "", None, "longer than all"]
    got = sorted((r.part, r.token) for r in search.word_parts(table, frame(spark, [(p,) for p in parts], "part string")).collect())
    assert got == sorted((p, w) for p in parts if p for w in words if p in w)
    assert search.word_parts(table, []).count() == 0


def test_whole_words_or_parts(spark):
    rows, table = sample(spark)
    terms = ["alpha", "phab", "x-r", "nothing", "ÉTÉ", ""]
    got = {(r.term, r.doc_id, r.pos, r.whole) for r in outline.whole_word_or_substring(table, terms).collect()}
    words = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower().replace("é", "e")).split()
    want = {("alpha", d, p, True) for d, p, t in rows if "alpha" in words(t)} | {("ÉTÉ", d, p, True) for d, p, t in rows if "ete" in words(t)}
    want |= {("phab", d, p, False) for d, p, t in rows if any("phab" in w for w in words(t))} | {("x-r", d, p, False) for d, p, t in rows if "x-r" in (t or "")}
    assert got == want


def test_fuzzy_search_equals_all_pairs(spark):
    rng = random.Random(8)
    letters = "abcdeé"
    rows = [(k, 0, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 6)))) for k in range(150)]
    table = frame(spark, [*rows, (900, 0, None)], "doc_id long, pos int, segment string").repartition(5)
    terms = ["abc", "dea bc", "éa", "cabbed", "-", ""]
    got = {(r.term, r.doc_id): (r.word_similarity, r.similarity) for r in search.fuzzy_search(table, terms, threshold=0.5, k=50).collect()}
    grams = lambda t: [g for w in search.WORD.findall(t.lower()) for g in search.word_grams(w)]
    want = {}
    for term in terms:
        own, scored = set(grams(term)), []
        for d, _, t in rows:
            mine = grams(t)
            best = max((len(own & set(mine[a:b])) / len(own | set(mine[a:b])) for a in range(len(mine)) for b in range(a + 1, len(mine) + 1)), default=0) if own else 0
            if round(best, 4) >= 0.5:
                scored.append((-round(best, 4), -round(len(own & set(mine)) / len(own | set(mine)), 4), d))
        want |= {(term, d): (-a, -b) for a, b, d in sorted(scored)[:50]}
    assert got == want and len(got) > 20


def test_nearest_keeps_k_rows_a_task(spark):
    rng = np.random.default_rng(0)
    vectors = np.round(rng.normal(size=(400, 3)), 1).astype(float)  # many ties
    table = frame(spark, [(int(k), v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(4)
    known = [(q, vectors[q] / np.linalg.norm(vectors[q])) for q in (0, 5, 9)]
    usable = table.where(F.exists("embedding", lambda x: x != 0))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert search.nearest_of_tasks(usable, known, 6, 2.0).count() == 4 * 6 * len(known)
        got = {(r.query_id, r["rank"]): (r.vec_id, r.distance) for r in search.semantic_topk(table, [0, 5, 9], 6, 2.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = np.linalg.norm(vectors, axis=1)
    for q, v in known:
        away = {k: round(1 - float(vectors[k] @ v / sizes[k]), 4) for k in range(400) if sizes[k]}
        best = sorted(away, key=lambda k: (away[k], k))[:6]
        assert [got[q, r + 1][0] for r in range(6)] == best


def test_natural_neighbours(spark):
    ids = ["x9", "x10", "x2", "x10-12", "y1", "x1.2", "x1.10", "x30", "x4"]
    rows = [(k, None if k[0] == "y" else "b", f"title {k}") for k in ids]
    table = frame(spark, rows, "text_id string, book string, title string")
    segments = frame(spark, [(k,) for k in ids if k != "x30"] * 2, "text_id string")
    want = ["x1.2", "x1.10", "x2", "x4", "x9", "x10", "x10-12"]
    for ranges in (1, 4, 9):
        got = {r.text_id: r for r in texts.natural_neighbours(table, segments, ["book"], shown=("title",), ranges=ranges).collect()}
        assert set(got) == {*want, "y1"} and got["y1"].previous is None and got["y1"].next is None
        for a, k, b in zip([None, *want], want, [*want[1:], None]):
            assert (got[k].previous and got[k].previous.text_id) == a and (got[k].next and got[k].next.title) == (b and f"title {b}")


def test_index_tables(spark, tmp_path):
    rows = [(k, f"one two {'three' if k % 3 else 'four'} word{k}", "two") for k in range(40)]
    table = frame(spark, rows, "id long, text string, note string")
    name = "pages_index"
    try:
        ingest.write_index(table.where("id < 30"), "id", ["text", "note"], name, 8, str(tmp_path))
        before = {f for f in tmp_path.rglob("*.parquet")}
        ingest.add_to_index(table.where("id >= 20"), "id", ["text", "note"], name, 8, str(tmp_path))
        ingest.add_to_index(table, "id", ["text", "note"], name, 8, str(tmp_path))
        assert before <= {f for f in tmp_path.rglob("*.parquet")}  # no file was written anew
        postings, sizes, statistics = ingest.read_index(spark, name)
        built = ingest.build_postings(table, "id", ["text", "note"])
        assert sorted(postings.select(*built.columns).collect()) == sorted(built.collect())
        assert sorted(statistics.select("token", "df", "n").collect()) == sorted(ingest.token_statistics(table, "id", ["text", "note"]).collect())
        assert sorted(statistics.select("token", "df", "n").collect()) == sorted(ingest.posting_statistics(built, "id").collect())
        found = search.phrase_search(postings, sizes, ["two three", "one two", "four one"], key="id", field="text", k=40)
        got = {(r["query"], r["id"]) for r in found.collect()}
        assert got == {(q, k) for k, t, _ in rows for q in ("two three", "one two") if q in t}
        plan = found._jdf.queryExecution().toString()
        assert "SelectedBucketsCount" in plan and "hashpartitioning(token" not in plan
    finally:
        for t in ("postings", "sizes", "statistics"):
            spark.sql(f"DROP TABLE IF EXISTS {name}_{t}")


def test_requests_with_null_keys_and_ties(spark):
    rows = frame(spark, [(1, "abc abc"), (1, "abc abc"), (None, "abc"), (2, None)], "doc_id long, segment string")
    found = needles.search_substrings(rows, frame(spark, [(7, "abc"), (7, "abc"), (None, "bc ")], "request_id int, needle string"), ["segment"], ["doc_id"])
    assert found.where("request_id = 7").count() == 6 and found.where("request_id is null").count() == 0
