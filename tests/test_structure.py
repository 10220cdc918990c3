"""Merging by partition, rules of order, nested documents, and term tables beyond the size of a broadcast."""

import json

from pyspark.sql import functions as F

from verseloom.operators import definitions, dictionary, ingest, outline, shared, texts
from verseloom.rules.canon import PROSE
from verseloom.sources.corpus import cited, table


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_merge_rewrites_touched_partitions_only(spark, tmp_path):
    schema = "book string, segment_id string, pos int, text string"
    path = f"{tmp_path}/segments"
    base = [("01", "a", 0, "x"), ("01", "b", 1, "y"), ("2", "a", 0, "z"), ("3", "c", 5, "w")]
    frame(spark, base, schema).write.partitionBy("book").parquet(path)
    names = lambda book: sorted(f.name for f in (tmp_path / "segments" / f"book={book}").glob("*.parquet"))
    before = {b: names(b) for b in ("01", "2", "3")}
    new = [("01", "b", 9, "Y1", 1), ("01", "b", 8, "Y2", 2), ("01", "d", 7, "v", 1), ("4", "e", 0, "u", 1), (None, "x", 0, "t", 1)]
    ingest.merge_into(path, frame(spark, new, schema + ", n int"), ["book", "segment_id"], "book", "n", kept=("pos",))
    got = sorted(map(tuple, spark.read.schema(schema).parquet(path).select("book", "segment_id", "pos", "text").collect()))
    assert got == [("01", "a", 0, "x"), ("01", "b", 1, "Y2"), ("01", "d", 7, "v"), ("2", "a", 0, "z"), ("3", "c", 5, "w"), ("4", "e", 0, "u")]
    assert names("2") == before["2"] and names("3") == before["3"] and names("01") != before["01"]


def test_order_rules_name_each_violation(spark):
    good = [("t", k, f"t:1.{k}") for k in range(12)]  # 1.9 before 1.10
    bad = [("u", 1, "u:1"), ("u", 2, "u:2"), ("u", 5, "u:3"), ("u", 6, "u:3"), ("v", 0, "v:10"), ("v", 1, "v:9")]
    rows = frame(spark, good + bad, "text_id string, pos int, segment_id string")
    for ranges in (1, 7):
        got = {r.rule: r.n for r in texts.order_rules(rows, ranges).collect()}
        assert got == {"first place isn't 0": 1, "gap before the place": 1, "id not above the one before": 2}
    assert all(r.n == 0 for r in texts.order_rules(rows.where("text_id = 't'"), 5).collect())
    assert {r.n for r in texts.order_rules(rows.limit(0)).collect()} == {0}


def test_orphans_and_pinned_counts(spark):
    child, parent = frame(spark, [(1,), (2,), (2,), (None,)], "k int"), frame(spark, [(1,), (None,)], "own int")
    assert [tuple(r) for r in texts.orphan_rules({"a": (child, "k", parent, "own"), "b": (parent, "own", child, "k")}).collect()] == [("a", 2), ("b", 0)]
    found = frame(spark, [("x", 3, 2), ("y", 1, 1)], "term string, segments int, texts int")
    pinned = frame(spark, [("x", 3, 2), ("y", 2, 1), ("z", 0, 0)], "term string, segments int, texts int")
    got = {r.term: (r.expected.segments, r.got and r.got.segments) for r in texts.pinned_differences(found, pinned, ["term"]).collect()}
    assert got == {"y": (2, 1), "z": (0, None)}


def levels(spark):
    top = frame(spark, [("p", "One"), ("q", "Two"), ("r", None)], "top string, name string")
    book = frame(spark, [("b1", "p"), ("b2", "p"), ("b3", "q"), ("b4", None)], "book string, top string")
    text = frame(spark, [("x10", "b1", "ten"), ("x9", "b1", None), ("x1", "b1", "one"), ("y", "b3", "why"), ("z", "nowhere", "?")], "text_id string, book string, title string")
    return [(top, "top", None, F.lit(0)), (book, "book", "top", F.col("book")), (text, "text_id", "book", outline.natural_key(F.col("text_id")))]


def test_nested_documents(spark):
    rows = {r.top: r for r in texts.nest(levels(spark)).collect()}
    assert set(rows) == {"p", "q"} and rows["p"].total == 3 and [b.book for b in rows["p"].children] == ["b1"]
    assert [t.text_id for t in rows["p"].children[0].children] == ["x1", "x9", "x10"]
    every = {r.top: r for r in texts.nest(levels(spark), empty=True).collect()}
    assert set(every) == {"p", "q", "r"} and [b.book for b in every["p"].children] == ["b1", "b2"] and every["r"].total == 0
    value = {r.top: json.loads(r.value) for r in texts.export_documents(texts.nest(levels(spark), empty=True), "top").collect()}
    assert value["r"]["name"] is None and value["p"]["children"][0]["children"][1] == {"text_id": "x9", "title": None}


def test_word_documents(spark):
    words = frame(spark, [("alpha", "s", "first"), ("alphabet", "s", "letters")], "word string, source string, text string")
    segs = frame(spark, [(1, 0, ["alpha", "x"])], "text_id long, pos int, tokens array<string>")
    report = dictionary.word_report(["alpha", "alph"], words, segs)
    got = {r.asked: json.loads(r.value) for r in texts.export_documents(report, "asked").collect()}
    assert got["alpha"]["entries"] == [{"source": "s", "text": "first"}] and got["alph"]["entries"] is None and got["alph"]["suggestions"] == ["alpha", "alphabet"]


def test_many_terms_define_like_few(spark, monkeypatch):
    rows = cited(table(spark, "/root/testdata/sf0.001", "documents"))
    terms = frame(spark, [(t,) for t in ("the", "tion", "la", "er", "un", "")], "term string")
    columns = ["term", "rank", "segment_id", "score", "context"]
    few = definitions.find_definitions(rows, terms, PROSE, 5).select(*columns).collect()
    monkeypatch.setattr(definitions, "FEW_TERMS", 0)
    monkeypatch.setattr(shared, "HOT_KEYS", 100_000)
    many = definitions.find_definitions(rows, terms, PROSE, 5).select(*columns).collect()
    assert sorted(few) == sorted(many) and len(few) > 5


def test_long_words_are_looked_up(spark):
    word = "x" * 90
    got = dictionary.lookup_words(frame(spark, [(word,), (word + "y",)], "word string"), frame(spark, [(word,)], "word string"), (("y", "", "case"),)).collect()
    assert {(r.word, r.entry) for r in got} == {(word, word), (word + "y", word)}


def test_reports_fall_back_to_parts_and_name_sources(spark):
    words = frame(spark, [("alpha", "s", "first"), ("alpha", "u", "second")], "word string, source string, text string")
    segs = frame(spark, [(1, 0, ["alpha", "x"]), (2, 0, ["alphabet"]), (3, 4, ["betray"])], "text_id long, pos int, tokens array<string>")
    known = frame(spark, [("s", "A Dictionary", "free"), ("v", "Another", "free")], "source string, title string, license string")
    got = {r.asked: r for r in dictionary.word_report(["alpha", "tray", "none"], words, segs, attributions=known).collect()}
    assert got["alpha"].examples == ["1:0"] and got["tray"].examples == ["3:4"] and got["none"].examples is None
    assert [tuple(a) for a in got["alpha"].attributions] == [("s", "A Dictionary", "free")] and got["tray"].attributions is None


def test_texts_with_edition_fallback_and_hierarchy(spark):
    segs = frame(spark, [("t1", "t1:1", 0, "root a", "own", "b1"), ("t1", "t1:2", 1, "root b", " ", "b1"), ("t2", "t2:1", 0, "root c", None, "b1")],
                 "text_id string, segment_id string, pos int, root string, other string, book string")
    editions = frame(spark, [("t1:1", "x", "x1"), ("t1:2", "y", "y2"), ("t1:2", "x", "x2"), ("t2:1", "x", "x3")], "segment_id string, edition string, text string")
    asked = frame(spark, [(1, "t1", None, None, None, None, None, None)], "request_id long, text_id string, around string, window int, range_start string, range_end string, offset int, limit int")
    books, groups = frame(spark, [("b1", "First", "g")], "book string, book_name string, grp string"), frame(spark, [("g", "Group")], "grp string, group_name string")
    levels = [(groups, "grp", None), (books, "book", "grp")]
    read = lambda **more: texts.read_texts(segs, asked, {"r": "root", "o": "other"}, ["o"], "r", translations=editions, translated="o", levels=levels, level="book", **more)[0]
    got = sorted((r.segment_id, r.root, r.other, r.book_name, r.group_name) for r in read().collect())
    assert got == [("t1:1", "root a", "own", "First", "Group"), ("t1:2", "root b", "x2", "First", "Group")]
    assert sorted((r.segment_id, r.other) for r in read(edition="y").collect()) == [("t1:1", None), ("t1:2", "y2")]
