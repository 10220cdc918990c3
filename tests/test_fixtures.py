"""Small fixtures: ids, outlines, slices, loading, dictionary, markup, definitions; and independence of partitioning."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from verseloom.functions import ids, markup
from verseloom.functions.text import fold
from verseloom.operators import definitions, dictionary, ingest, outline, search, survey, texts
from verseloom.plans.registry import QUERIES
from verseloom.rules import canon
from verseloom.sources.corpus import assign_collection, read_text_tree

SF = "/root/testdata/sf0.001"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def segs(spark, rows):
    """Rows ``(segment id, text)`` of texts in order; the text is the id's prefix unless given."""
    full = [(r[2] if len(r) > 2 else r[0].split(":")[0], r[0], k, r[1]) for k, r in enumerate(rows)]
    return frame(spark, full, "text_id string, segment_id string, pos int, text string")


def test_ids(spark):
    good = ["mn1", "dn22", "sn56.11", "dhp1-20", "an11.502-981", "pli-tv-bu-vb-pj1", "pli-tv-bu-pm", "mil3.1.1", "patthana1.1", "tha-ap12"]
    bad = ["MN1", "mn 1", "", "1mn", "mn1;drop", None]
    kept, out = texts.validate_ids(frame(spark, [(x,) for x in good + bad], "text_id string"))
    assert {r[0] for r in kept.collect()} == set(good) and out.count() == len(bad)
    rows = frame(spark, [("dn16:2.1.0",), ("sn56.11:14.4",), ("dhp1:0.1",), ("plain",)], "s string")
    got = rows.select(ids.id_prefix(F.col("s")), ids.id_rest(F.col("s")), ids.top_group(F.col("s")), ids.paragraph_key(F.col("s")), ids.is_heading(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [
        ("dn16", "2.1.0", "2", "dn16:2.1", False), ("sn56.11", "14.4", "14", "sn56.11:14", False), ("dhp1", "0.1", "0", "dhp1:0", True), ("plain", "", "", "plain", False)
    ]
    books = frame(spark, [("mn141",), ("mil7.2.2",), ("pli-tv-bu-vb-ss11",), ("mnd3",), ("7",)], "t string")
    assert [r[0] for r in books.select(ids.book_prefix(F.col("t"))).collect()] == ["mn", "mil", "pli-tv-bu-vb-ss", "mnd", "7"]
    assert [r[0] for r in books.where(ids.in_sources(F.col("t"), ["mn", "pli-tv"])).collect()] == ["mn141", "pli-tv-bu-vb-ss11"]
    layer = ids.stratum(F.col("t"), dict(canon.CANON.strata), "pli-tv", 2, 3)
    assert [r[0] for r in books.select(layer).collect()] == [0, 3, 2, 3, 3]
    assert ids.parse_sources("ebt, nosuch", canon.PRESETS, canon.KNOWN_BOOKS) == sorted(canon.PRESETS["ebt"])
    assert ids.parse_sources("suttas", canon.PRESETS, canon.KNOWN_BOOKS) == []


def test_decode_ids(spark):
    want = {
        "sn56.11": "Saṁyutta Nikāya · saṁyutta 56, sutta 11",
        "dn22": "Dīgha Nikāya · sutta 22",
        "dhp1-20": "Dhammapada · verses 1–20",
        "pli-tv-bu-pm": "Vinaya · Pāli · Theravāda · Bhikkhu · Pātimokkha",
        "pli-tv-bu-vb-pj1": "Vinaya · Pāli · Theravāda · Bhikkhu · Vibhaṅga · Pārājika 1",
        "mil3.1.1": "Milindapañha · 3.1.1",
        "patthana1.1": "Paṭṭhāna · section 1, subsection 1",
        "tha-ap5": "Therāpadāna · sutta 5",
        "dn": "Dīgha Nikāya",
        "xyz9": "xyz9",
        "": "",
    }
    rows = frame(spark, [(k,) for k in want], "t string")
    name = ids.decode_id(F.col("t"), canon.BOOK_NAMES, canon.NUMBER_NAMES, canon.DOTTED_NAMES, canon.PART_NAMES, "pli-tv-")
    assert {r[0]: r[1] for r in rows.select("t", name).collect()} == want


def test_outlines(spark):
    rows = [("dn9:0.1", "Book"), ("dn9:0.2", "Title"), ("dn9:1.0", "First"), ("dn9:1.1", "a"), ("dn9:2.1.0", "Second"), ("dn9:2.1.1", "b"), ("dn9:2.1.2", "c")]
    rows += [(f"dhp{k}:1", f"v{k}", "dhp1-3") for k in (1, 2, 3)] + [("mn1:1.1", "x"), ("mn1:1.2", "y"), ("mn1:2.1", "z")]
    got = sorted((r.text_id, r.section, r.key, r.grp, r.title, r.first_segment_id, r.last_segment_id, r.offset, r.segment_count) for r in texts.outline(segs(spark, rows)).collect())
    assert got == sorted(
        [
            ("dn9", 1, "1", "1", "First", "dn9:0.1", "dn9:1.1", 0, 4),
            ("dn9", 2, "2", "2", "Second", "dn9:2.1.0", "dn9:2.1.2", 4, 3),
            *[("dhp1-3", k, f"dhp{k}", f"dhp{k}", None, f"dhp{k}:1", f"dhp{k}:1", k - 1, 1) for k in (1, 2, 3)],
            ("mn1", 1, "1", "1", None, "mn1:1.1", "mn1:1.2", 0, 2),
            ("mn1", 2, "2", "2", None, "mn1:2.1", "mn1:2.1", 2, 1),
        ]
    )


def test_titles(spark):
    rows = [("dn1:0.1", "Book"), ("dn1:0.2", " Net "), ("mn2:0.1", "A"), ("mn2:0.2", "B"), ("mn2:0.3", "C"), ("an3:0.1", "~"), ("sn4:1.1", "no heading"), ("ud5:0.1", "own")]
    curated = frame(spark, [("ud5", "chosen"), ("zz9", "  ")], "text_id string, text string")
    got = {r.text_id: r.text for r in texts.text_titles(segs(spark, rows), ["text"], curated).collect()}
    assert got == {"dn1": "Net", "mn2": "C", "an3": None, "ud5": "chosen", "zz9": None}


def test_slices(spark):
    source = segs(spark, [(f"dn1:1.{k}", f"t{k}") for k in range(250)])
    asks = [
        (1, "dn1", "dn1:1.10", 5, None, None, None, None), (2, "dn1", None, None, "dn1:1.3", "dn1:1.6", None, None), (3, "dn1", None, None, None, None, 0, 100),
        (4, "dn1", None, None, None, None, 100, 100), (5, "dn1", None, None, "dn1:1.240", None, None, None), (6, "dn1", "dn1:1.0", 999, None, None, None, None),
        (7, "dn1", None, None, None, None, None, None), (8, "dn1", None, None, None, None, 900, 0),
        (20, "dn1", "dn1:9.9", 5, None, None, None, None), (21, "dn1", "dn1:1.1", 5, "dn1:1.1", None, None, None), (22, "dn1", None, None, None, "dn1:1.3", None, None),
        (23, "dn1", None, None, "dn1:1.6", "dn1:1.3", None, None), (24, "mn9", None, None, None, None, 0, 5), (25, None, None, None, None, None, 0, 5),
    ]
    rows, rejected = texts.slices(source, frame(spark, asks, texts.REQUEST))
    got = {}
    for r in rows.collect():
        got.setdefault(r.request_id, []).append(r)
    span = {k: (min(r.idx for r in v), max(r.idx for r in v), len(v), v[0].has_more, v[0].next_offset) for k, v in got.items()}
    assert span == {
        1: (5, 15, 11, True, 16), 2: (3, 6, 4, True, 7), 3: (0, 99, 100, True, 100), 4: (100, 199, 100, True, 200),
        5: (240, 249, 10, False, None), 6: (0, 200, 201, True, 201), 7: (0, 249, 250, False, None),
    }
    assert {r.request_id: r.error for r in rejected.collect()} == {
        20: "unknown segment", 21: "several selectors", 22: "range without a start", 23: "range ends before its start", 24: "unknown text", 25: "unknown text"
    }


def test_upserts(spark):
    base = frame(spark, [("a", "old", 1), ("b", "kept", 2)], "k string, text string, place int")
    new = frame(spark, [("a", "first", 7, 1), ("a", "last", 8, 2), ("c", "new", 9, 1), (None, "lost", 0, 1)], "k string, text string, place int, at int")
    got = {r.k: (r.text, r.place) for r in ingest.upsert(base, new, ["k"], "at", kept=("place",)).collect()}
    assert got == {"a": ("last", 1), "b": ("kept", 2), "c": ("new", 9)}
    assert ingest.upsert(base, new.limit(0), ["k"], "at").count() == 2 and ingest.upsert(base.limit(0), new, ["k"], "at").count() == 2
    known = frame(spark, [("s1",)], "segment_id string")
    kind = "segment_id string, language string, edition string, text string"
    more = frame(spark, [("s1", "en", "x", "1", 1), ("s1", "en", "x", "2", 2), ("s9", "en", "x", "3", 3)], kind + ", at int")
    assert [tuple(r) for r in ingest.upsert_translations(spark.createDataFrame([], kind), more, known, "at").collect()] == [("s1", "en", "x", "2")]


def test_files(spark, tmp_path):
    for name, body in {"sutta/mn/mn1_root-pli-ms": {"mn1:1.2": "b", "mn1:1.1": "a"}, "vinaya/pli-tv-bu-pm_root-pli-ms": {"pli-tv-bu-pm:1.1": "x"}}.items():
        path = tmp_path / f"{name}.json"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(body, indent=1))
    (tmp_path / "sutta/mn/mn2_root.json").write_text("not json")
    rows = assign_collection(read_text_tree(spark, str(tmp_path)), canon.TOP_FILES)
    got = [(r.text_id, r.collection, r.segment_id, r.pos, r.text) for r in rows.orderBy("text_id", "pos").collect()]
    assert got == [("mn1", "mn", "mn1:1.2", 0, "b"), ("mn1", "mn", "mn1:1.1", 1, "a"), ("pli-tv-bu-pm", "pli-tv-bu-vb", "pli-tv-bu-pm:1.1", 0, "x")]
    out = str(tmp_path / "dictionary")
    words = frame(spark, [(" Abc ", "<p>one</p>"), ("", "x"), ("d", None)], "word string, text string")
    ingest.replace_source(ingest.dictionary_rows(words, "one", "en", markup.clean_html), out)
    ingest.replace_source(ingest.dictionary_rows(words, "two", "en", markup.clean_html, lower=False), out)
    ingest.replace_source(ingest.dictionary_rows(frame(spark, [("z", "y")], "word string, text string"), "one", "en", markup.clean_html), out)
    assert {(r.word, r.text, r.source) for r in spark.read.parquet(out).collect()} == {("z", "y", "one"), ("Abc", "one", "two")}
    counts = ingest.export_tables({"t": (frame(spark, [(2, "b", 1.0), (1, "a", 2.0)], "id int, name string, vector double"), ["id", "name"])}, str(tmp_path / "export"))
    assert [tuple(r) for r in counts.collect()] == [("t", 2)] and spark.read.parquet(str(tmp_path / "export/t")).columns == ["id", "name"]


def test_dictionary(spark):
    entries = frame(spark, [("dhamma",), ("dhammā",), ("tā",), ("nadī",), ("a",)], "word string")
    asked = frame(spark, [(w,) for w in ("dhamma", "dhammānaṁ", "dhammāya", "nadīnaṃ", "ao", "zzz", "dhammena", None)], "word string")
    got = {r.word: (r.entry, r.suffix, r["case"]) for r in dictionary.lookup_words(asked, entries, canon.LEMMA_RULES).collect()}
    assert got == {
        "dhamma": ("dhamma", None, None), "dhammānaṃ": ("dhamma", "ānaṃ", "gen./dat. pl."), "dhammāya": ("dhammā", "āya", "dat./gen. sg. (f.)"),
        "nadīnaṃ": ("nadī", "īnaṃ", "gen./dat. pl. (f.)"), "ao": (None, None, None), "zzz": (None, None, None), "dhammena": ("dhamma", "ena", "inst. sg."),
    }
    text = frame(spark, [("“Evaṁ me, SUTAṀ— me” a\u00a0(x1)",), (None,), ("",)], "t string")
    assert [r[0] for r in text.select(dictionary.dictionary_tokens(F.col("t"))).collect()] == [["evaṃ", "me", "sutaṃ", "x1"], [], []]
    stems = frame(spark, [("dhammassa",), ("bhikkhūnaṁ",)], "w string").select(dictionary.candidate_stems(F.col("w"), canon.STEM_RULES, canon.SHORTENED).alias("s"))
    a, b = [r.s for r in stems.collect()]
    assert a.stems == ["dhamma", "dhammaa", "dhammai", "dhammassa", "dhammau"] and a.suffixes == ["assa", "ssa"]
    assert {"bhikkhu", "bhikkhūnaṁ", "bhikkhūna"} <= set(b.stems) and b.suffixes == ["aṁ", "naṁ", "ūnaṁ", "ṁ"]


def test_markup():
    assert markup.plain_text("<p>a &amp; b <span class='grammar'>adj</span>c</p><br>\n\n<i> d </i>") == "a & b\n[adj]\nc\nd"
    assert markup.plain_text(None) == "" and markup.plain_text("<script>x</script>y<!-- z -->") == "y"
    assert markup.rendered("<b lang='pi'>A</b> <a href='x'>k</a><script>1</script> <j>&\x00") == "<b>A</b> k&lt;script&gt;1&lt;/script&gt; <br>&amp;"
    assert markup.rendered("Kosambī, kosambi!", query="kosambi") == "<mark>Kosambī</mark>, <mark>kosambi</mark>!"
    assert markup.rendered("sabba sabbakāya <em>Sabbaṁ</em>", frozenset(("sabba", "sabbam"))) == "<mark>sabba</mark> sabbakāya <em><mark>Sabbaṁ</mark></em>"
    assert markup.rendered("") is None


def test_links(spark):
    rows = frame(spark, [("https://r.example/{text}#{rest}",), ("javascript:{text}",), (None,)], "t string")
    link = markup.deep_link("/read", F.lit("mn141"), F.lit("mn141:16.3"), F.col("t"))
    assert [r[0] for r in rows.select(link).collect()] == ["https://r.example/mn141#16.3", "/read/mn141#mn141:16.3", "/read/mn141#mn141:16.3"]
    cite = markup.citation(F.lit("mn1"), F.lit("Root"), F.lit("Title"), F.lit("Middle")), markup.citation(F.lit("mn1"), F.lit(None), F.lit(None), F.lit(None))
    assert tuple(rows.select(*cite).first()) == ("Title (Root, MN1), Middle", "mn1 (MN1), ")


LINES = [  # term dukkha; each line's kind and markers
    ("mn1:1.1", "Katamañca dukkhaṁ?", "direct interrogative"),
    ("mn1:1.2", "idaṁ vuccati dukkhaṁ", "direct predicate closer"),
    ("mn1:1.3", "dukkhaṁ nāma", "direct named"),
    ("mn1:1.4", "nāmadukkhaṁ nāmarūpa dukkhaṁ nāmapaccayā", None),
    ("mn1:1.5", "dukkhudrayo vuccati", None),
    ("mn1:1.6", "dukkhe vuccanti", None),
    ("mn1:1.7", "dukkhassa nirodho vuccati", None),
    ("mn1:1.8", "dukkhassa adhivacanaṁ", "direct predicate"),
    ("mn1:1.9", "kataṁ dukkhaṁ", None),
    ("mn1:2.1", "dukkhaṁ daṭṭhabbaṁ", None),
    ("mn1:2.2", "kattha ca dukkhaṁ daṭṭhabbaṁ", "direct interrogative"),
    ("mn1:2.3", "seyyathāpi dukkhaṁ", "simile simile"),
    ("mn1:2.4", "vuccati " + "x " * 13 + "dukkhaṁ", "direct predicate"),
    ("mn1:2.5", "vuccati " + "x " * 14 + "dukkhaṁ", None),
    ("mn1:2.6", "ayaṁ vuccati bhikkhave dukkhaṁ", "direct predicate closer"),
    ("mn1:2.7", "ayaṁ vuccati bhikkhave ariya dukkhaṁ", "direct predicate"),
    ("mn1:2.8", "no marker dukkhaṁ", None),
    ("mn1:2.9", None, None),
]


def test_classification(spark):
    terms = definitions.term_table(spark, ["dukkha"], canon.CANON)
    rows = definitions.classify(definitions.candidates(segs(spark, [x[:2] for x in LINES]), terms, canon.CANON), canon.CANON)
    got = {r.segment_id: " ".join([r.kind, *r.markers, *(["closer"] if r.closer else [])]) for r in rows.collect()}
    assert got == {k: v for k, _, v in LINES if v}
    scored = {r.segment_id: r.score for r in definitions.score(rows, canon.CANON).collect()}
    assert scored["mn1:1.2"] == 100 + 25 + 13 + 6 and scored["mn1:1.1"] == 90 + 25 + 13 and scored["mn1:2.3"] == 40 + 25 + 13


def test_context_dedup_and_places(spark):
    rows = [("mn9:1.1", "pathamaṁ jhānaṁ"), ("mn9:1.2", "seyyathāpi nhāpako"), ("mn9:1.3", "evameva kho"), ("mn9:2.1", "other"), ("mn9:2.2", "seyyathāpi puriso"), ("mn9:2.3", "evameva"), ("mn9:3.2", "seyyathāpi x jhānaṁ")]
    rows += [("sn8:1.1", "katamaṁ jhānaṁ?"), ("cnd2:1.1", "Katamaṁ jhānaṁ"), ("sn8:1.2", "idaṁ vuccati jhānaṁ"), ("sn8:1.3", "catubbidhaṁ tayo")]
    terms = definitions.term_table(spark, ["jhāna", "", "zz"], canon.CANON)
    assert [r.segment_id for r in definitions.context_examples(segs(spark, rows), terms, canon.CANON).collect()] == ["mn9:1.2"]
    found = definitions.find_definitions(segs(spark, rows), ["jhāna", "zz"], canon.CANON, 4).orderBy("rank").collect()
    assert [(r.segment_id, r.context) for r in found] == [("sn8:1.2", False), ("sn8:1.1", False), ("cnd2:1.1", False), ("mn9:1.2", True)]
    assert found[0].detail == "enumerative" and [b.segment_id for b in found[0].block] == ["sn8:1.1", "sn8:1.2", "sn8:1.3"]
    assert definitions.find_definitions(segs(spark, rows), ["jhāna"], canon.CANON, 4, False, ["mn"]).count() == 0
    merged = definitions.merge_same_passage(definitions.find_definitions(segs(spark, rows), ["jhāna"], canon.CANON, 9))
    assert "sn8:1.1" not in [r.segment_id for r in merged.collect()]


def test_word_similarity_by_brute_force():
    def plain(needle, grams):
        runs = [set(grams[a:b]) for a in range(len(grams)) for b in range(a + 1, len(grams) + 1)]
        return max((len(needle & r) / len(needle | r) for r in runs), default=0.0)

    for letters in itertools.product("abc", repeat=6):
        grams = [letters[k] + letters[k + 1] for k in range(5)]
        for needle in ({"ab", "bc"}, {"aa"}, {"ca", "ab", "zz"}):
            assert abs(search.extent_similarity(needle, grams) - plain(needle, grams)) < 1e-12


def test_fuzzy_search_finds_all_above_the_threshold(spark):
    rows = frame(spark, [(1, 0, "the kosambi grove"), (2, 0, "kosambhi"), (3, 0, "other words"), (4, 0, None), (5, 0, "Kosambi kosambi")], "doc_id long, pos int, segment string")
    got = {r.doc_id: r.word_similarity for r in search.fuzzy_search(rows, ["kosambi", ""]).collect()}
    assert got[1] == got[5] == 1.0 and 0.6 <= got[2] < 1 and set(got) == {1, 2, 5}


def test_languages(spark):
    root = frame(spark, [("a", "\u2003 x \t"), ("b", "  "), ("c", None), ("d", "y")], "segment_id string, text string")
    en = frame(spark, [("a", " one "), ("a", "two"), ("d", " "), ("z", "no")], "segment_id string, text string")
    got = {r.segment_id: r.text_en for r in texts.align_languages(root, {"en": en}).collect()}
    assert got == {"a": "one", "d": None}


def test_embedding_lengths_and_shared_vectors(spark):
    vectors = frame(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, None), (5, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert {(r.query_id, r.vec_id) for r in search.semantic_topk(vectors, [1, 3]).collect()} == {(1, 1), (1, 2), (3, 3)}
    docs = frame(spark, [(1, "alpha beta"), (2, "alpha")], "doc_id long, text string")
    both = search.hybrid_search(docs, vectors, {"alpha": 1, "beta": 1})
    assert {r.query for r in both.collect()} == {"alpha", "beta"}
    made = search.embed_corpus(docs.select(F.col("doc_id").alias("id"), "text"), vectors.where("vec_id = 1")).collect()
    assert [r.vec_id for r in made] == [2] and abs(sum(x * x for x in made[0].embedding) - 1) < 1e-6


def test_survey_phrases_and_empty_tables(spark):
    rows = frame(spark, [(1, "en", "s", 0, "The Great Vehicle"), (2, None, "s", 0, None), (3, "en", "s", 0, "great  vehicle")], "doc_id long, lang string, source string, pos int, segment string")
    terms = survey.term_table(spark, [("great vehicle", "word"), ("gre", "stem"), ("absent", "word"), ("", "word")])
    got = {r.term: (r.total_segments, r.total_texts) for r in survey.survey_totals(rows, terms).collect()}
    assert got == {"great vehicle": (1, 1), "gre": (2, 2), "absent": (0, 0), "": (0, 0)}
    assert survey.survey_corpus(rows.limit(0), terms, 1, 5).where("total_segments = 0 and next_cursor is null").count() == 4
    assert outline.whole_word_or_substring(rows, ["gre", "great", "e g"]).where("term = 'e g'").count() == 1


def test_neighbours_across_ranges(spark):
    rows = frame(spark, [("a", k) for k in (0, 5, 9, 25, 26, 99)] + [("b", 7), (None, 8)], "book string, n long")
    got = {r.n: (r.previous, r.next) for r in texts.neighbours(rows, ["book"], "n", 10).collect()}
    assert got == {0: (None, 5), 5: (0, 9), 9: (5, 25), 25: (9, 26), 26: (25, 99), 99: (26, None), 7: (None, None), 8: (None, None)}


RANKED = ["bm25_search", "phrase_search", "semantic_topk", "hybrid_search", "fuzzy_words", "prefix_suggestions", "related_words", "survey_page", "reserve_slots", "find_definitions", "slices", "outline"]


@pytest.mark.parametrize("name", RANKED)
def test_partitioning_changes_nothing(spark, name):
    results = []
    for n in ("1", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            results.append(sorted(map(str, QUERIES[name](spark, SF).collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert results[0] == results[1] and results[0]


def test_fold_of_odd_texts(spark):
    rows = frame(spark, [("Ærø Straße",), (None,), ("",), ("e\u0301",)], "t string")
    assert [r[0] for r in rows.select(fold(F.col("t"))).collect()] == ["ærø straße", "", "", "e"]


def test_word_report(spark):
    words = frame(spark, [("mind", "b", "2"), ("mind", "a", "1"), ("mindful", "a", "3"), ("remind", "a", "4"), ("minder", "a", "5")], "word string, source string, text string")
    tokens = frame(spark, [("t1", 0, ["mind"]), ("t1", 1, ["mind", "x"]), ("t2", 0, ["mind"]), ("t3", 0, [])], "text_id string, pos int, tokens array<string>")
    got = {r.asked: r for r in dictionary.word_report(["mind", "minde", "zz"], words, tokens).collect()}
    assert [tuple(e) for e in got["mind"].entries] == [("a", "1"), ("b", "2")] and got["mind"].suggestions is None
    assert got["mind"].related == ["minder", "remind", "mindful"]
    assert {x.split(":")[0] for x in got["mind"].examples} == {"t1", "t2"} and len(got["mind"].examples) == 2
    assert got["minde"].entries is None and got["minde"].suggestions == ["minder"]
    assert got["zz"].related is None and got["zz"].examples is None


def test_definitions_page(spark):
    rows = [("sn1:0.1", "Title one"), ("sn1:1.1", "katamaṁ jhānaṁ?"), ("sn1:1.2", "a"), ("sn1:1.3", "idaṁ vuccati jhānaṁ"), ("mn2:0.1", "~")]
    rows += [(f"mn2:{k}.1", f"jhānaṁ {k} vuccati") if k % 20 == 0 else (f"mn2:{k}.1", f"line {k}") for k in range(1, 90)]
    source = segs(spark, rows)
    page = definitions.definitions_page(source, ["jhāna"], canon.CANON, texts.text_titles(source, ["text"]), 3, 2).orderBy("rank").collect()
    assert [(r.segment_id, r.title) for r in page] == [("sn1:1.3", "Title one"), ("mn2:20.1", None), ("mn2:40.1", None)]


def test_export_texts(spark):
    rows = segs(spark, [("mn1:1.1", "a"), ("mn1:1.2", None)])
    value = texts.export_texts(rows, frame(spark, [("mn1", "en"), ("mn2", None)], "text_id string, lang string")).orderBy("text_id").collect()
    assert json.loads(value[0].value) == {"text_id": "mn1", "lang": "en", "segments": [{"pos": 0, "segment_id": "mn1:1.1", "text": "a"}, {"pos": 1, "segment_id": "mn1:1.2", "text": None}]}
    assert json.loads(value[1].value) == {"text_id": "mn2", "lang": None, "segments": None}
