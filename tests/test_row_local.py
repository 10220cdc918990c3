"""Jobs whose tokens are matched in the row they stand in: the same results as by joins, without rows of tokens in a shuffle."""

from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from verseloom.functions import markup
from verseloom.functions.text import folded_tokens, tokens_of
from verseloom.operators import definitions, dictionary, search, survey
from verseloom.rules.canon import PROSE, PROSE_LEMMAS
from verseloom.sources.corpus import segments

TEXTS = [(1, "en", "a", "The thé THE\nno hit\nthen ones"), (2, "en", "b", "the\n\nof the"), (3, None, "c", None), (None, "fr", "d", "la Éthe the"), (4, "de", "e", "")]
TERMS = [("the", "word"), ("the", "stem"), ("thé", "word"), ("zzz", "word"), ("of the", "word"), ("", "stem")]


def _docs(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")


def _exchanged(rows) -> str:
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_of_a_text_are_those_of_the_column(spark):
    odd = ["Étion ǅ İx Kelvin éa Straße ſs a_b 9½ ﬁ ΑΣ", "", None, "̀́", "ÀÉ\nx\ty"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, t string")
    for r in rows.select("t", folded_tokens(F.col("t")).alias("tokens")).collect():
        assert tokens_of(r["t"]) == r["tokens"]


def test_survey_totals_by_runs_equal_those_by_join(spark):
    terms = survey.term_table(spark, TERMS)
    for rows in (TEXTS, TEXTS + TEXTS[:2], TEXTS + [(2, "en", "b", "x\ny\nz\nthe one")]):
        docs = segments(_docs(spark, rows)).repartition(3)
        for part in (segments(_docs(spark, rows)), docs):
            got, want = (sorted(map(tuple, survey.survey_totals(part, terms, few).collect())) for few in (100, 0))
            assert got == want


def test_survey_totals_sends_no_row_a_hit_through_a_shuffle(spark):
    terms = survey.term_table(spark, TERMS[:4])
    plan = _exchanged(survey.survey_totals(segments(_docs(spark)), terms))
    assert "pos" not in plan and "regexp_extract_all" not in plan


def test_definitions_of_few_terms_equal_those_of_many(spark, monkeypatch):
    """Sent to all tasks or joined by form: the same candidates, and no row of a token in the plan of few."""
    heads = [*PROSE.interrogative, *PROSE.predicate, *PROSE.simile, PROSE.named, PROSE.question_word, PROSE.designation, PROSE.closing, PROSE.opening, PROSE.answer]
    rows = [("t1", f"t1:{k}.1", k, f"thé tion {h}x {PROSE.demonstratives[0]} {h} Theo the") for k, h in enumerate(heads)]
    rows += [("t1", "t1:0.2", 90, "the only"), ("t2", "t2:1.1", 0, None), ("t2", "t2:1.2", 1, f"{PROSE.opening} {PROSE.answer}"), ("t2", "t2:1.1", 2, "tion")]
    segs = spark.createDataFrame(rows, "text_id string, segment_id string, pos int, text string")
    terms = definitions.term_table(spark, ["the", "tion", "la"], PROSE)

    def found():
        held = definitions.candidates(segs, terms, PROSE)
        kept = [sorted((r.term, r.segment_id, r.pos, r.places, sorted(r.present), [tuple(m) for m in r.marks]) for r in held.collect())]
        return held, kept + [sorted(map(str, definitions.scored_definitions(segs, terms, PROSE).collect()))]

    plan, few = found()
    assert few[0] and "regexp_extract_all" not in _exchanged(plan)
    monkeypatch.setattr(definitions, "FEW_TERMS", 0)
    assert found()[1] == few


def test_posting_sizes_and_vocabulary_count_by_text(spark):
    docs = _docs(spark, TEXTS + TEXTS[:1])
    got = {(r.doc_id, r.token): (r.n, r.first_pos, r.last_pos) for r in search.posting_sizes(docs).collect()}
    want = {(r.doc_id, r.token): (len(r.positions), r.positions[0], r.positions[-1]) for r in search.postings(docs).collect()}
    assert got == want
    words = {r.token: (r.n_texts, r.n_total) for r in search.vocabulary(docs).collect()}
    assert words["the"] == (3, 9) and words["of"] == (1, 1)
    assert "Aggregate" not in _exchanged(search.posting_sizes(_docs(spark)))


def test_word_parts_without_an_index_of_grams(spark):
    words = spark.createDataFrame([("the",), ("then",), ("he",), ("a",), ("the",)], "token string")
    parts = spark.createDataFrame([("he",), ("the",), ("zz",), ("",), (None,), ("a",)], "part string")
    found = search.word_parts(words, parts)
    assert sorted(map(tuple, found.collect())) == [("a", "a"), ("he", "he"), ("he", "the"), ("he", "then"), ("the", "the"), ("the", "then")]
    assert "Join" not in _exchanged(found)


def test_what_fuzzy_search_keeps_of_words_is_small():
    known = search.FuzzyTerms(["the from"], 0.6)
    for k in range(60_000):
        known.alike(f"word{k} the from")
    assert len(known.grams) <= 50_000 and known.known["zzz"] is known.known["yyy"]
    assert known.grams["abc"][0] is known.grams["abd"][0]


def test_clean_html_takes_a_page_at_a_time(spark):
    rows = spark.createDataFrame([("<b>a</b>&amp;",), (None,), ("",)], "html string")
    out = rows.select(markup.clean_html(F.col("html")).alias("t"))
    assert [r.t for r in out.collect()] == [markup.plain_text("<b>a</b>&amp;"), "", ""]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert f", {PythonEvalType.SQL_SCALAR_ARROW_UDF}" in plan


def test_dictionary_coverage_of_few_words_equals_that_of_many(spark):
    suffix, vowel, _ = PROSE_LEMMAS[0]
    texts = [(1, f"(The) the, saṁ\u3000\u0301e '' x “dogs” stem{suffix} {suffix}"), (1, "the new"), (2, None), (3, " ,; "), (None, "un\x85deux\xa0trois ½a_b İx"), (4, f"ab{suffix}{suffix}")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    words = spark.createDataFrame([("the",), ("saṃ",), (f"stem{vowel}",), (None,), ("deux",), (f"ab{suffix}{vowel}",), ("½a_b",)], "word string")
    few, many = (dictionary.dictionary_coverage(docs, words, PROSE_LEMMAS, few=n) for n in (100, 0))
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    assert "Join" not in _exchanged(few)
