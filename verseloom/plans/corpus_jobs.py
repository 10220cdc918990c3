"""Queries of the jobs over cited texts, editions, dictionaries and definitions, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from verseloom.functions import ids, markup
from verseloom.functions.text import fold, folded_tokens
from verseloom.operators import catalog, definitions, dictionary, ingest, needles, outline, search, survey, texts
from verseloom.rules.canon import PROSE, PROSE_LEMMAS
from verseloom.sources.corpus import assign_collection, cited, segments, table

DEFINED = ["the", "tion", "la", "er", "rea"]
WORDS = ["the", "einach", "thon", "zuver"]
PHRASES = ["of the", "in the", "que la"]
ALIKE = ["the from", "einach", "ereringre"]
ASKED = {0: ("the", "word"), 7: ("un", "stem"), 42: ("de", "word")}  # vector ids, and the words to look for
NAMES = {"en": "English", "de": "German", "fr": "French"}


def _docs(s, d):
    return table(s, d, "documents")


def _cited(s, d):
    return cited(_docs(s, d))


def _translations(s, d):
    """Turns as editions of segments: two turns a segment."""
    return table(s, d, "conversations").select(
        F.concat_ws(":", "conv_id", F.expr("turn div 2")).alias("segment_id"),
        F.col("conv_id").alias("text_id"),
        F.lit("xx").alias("language"),
        F.col("role").alias("edition"),
        F.concat(F.lit("by "), F.col("role")).alias("translator"),
        "text",
        F.col("turn").cast("long").alias("turn"),
    )


def _roots(s, d):
    return _translations(s, d).where("edition = 'user'").select("segment_id", "text_id", "turn", "text")


def _levels(s, d):
    region = table(s, d, "region").select("r_regionkey")
    nation = table(s, d, "nation").select("n_nationkey", "n_regionkey")
    customer = table(s, d, "customer").select("c_custkey", "c_nationkey")
    orders = table(s, d, "orders").select("o_orderkey", "o_custkey")
    return [
        (region, "r_regionkey", None),
        (nation, "n_nationkey", "n_regionkey"),
        (customer, "c_custkey", "c_nationkey"),
        (orders, "o_orderkey", "o_custkey"),
    ]


def _sizes(s, d):
    lines = table(s, d, "lineitem").where("l_quantity > 49 and l_returnflag = 'R'")
    return lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))


def _with_hierarchy(s, d):
    region = table(s, d, "region").select("r_regionkey", "r_name")
    nation = table(s, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    customer = table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    levels = [(region, "r_regionkey", None), (nation, "n_nationkey", "r_regionkey"), (customer, "c_custkey", "n_nationkey")]
    orders = table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return texts.with_hierarchy(orders, levels, "c_custkey").groupBy("r_name", "n_name").agg(F.count("*").alias("n"))


def _entries(s, d):
    return markup.extract_glossary(table(s, d, "pages"), "page_id", "(?i)<b>", r"(?i)<br\s*/?>")


def _dictionary(s, d):
    return table(s, d, "benchmark").select(F.explode(dictionary.dictionary_tokens(F.col("text"))).alias("word"), "item_id", "text")


def _pages(s, d):
    """Collections with their books and texts; books without texts go."""
    region, nation, customer = table(s, d, "region"), table(s, d, "nation"), table(s, d, "customer")
    return texts.nest([
        (region.select("r_regionkey", "r_name"), "r_regionkey", None, F.lit(0)),
        (nation.select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey")), "n_nationkey", "r_regionkey", F.col("n_nationkey")),
        (customer.select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey")), "c_custkey", "n_nationkey", outline.natural_key(F.col("c_name"))),
    ])


def _headwords(s, d):
    """Every word of the dictionary, once as a word and once as a stem."""
    words = _dictionary(s, d).select(F.col("word").alias("term")).where("term not like '% %'").distinct()
    return words.withColumn("scope", F.explode(F.array(F.lit("word"), F.lit("stem"))))


def _two_words(s, d):
    """All pairs of words that stand side by side in the entries."""
    words = F.split("text", " ")
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
    rows = table(s, d, "benchmark").where(F.size(words) > 1).select(F.explode(pairs).alias("term"))
    return rows.withColumn("scope", F.lit("word")).distinct()


def _requests(s, d):
    """Two requests a text: around its eighth segment, and its second ten; odd texts ask for a segment that isn't there."""
    rows = _cited(s, d).where("pos = 0").select("text_id", "doc_id", F.col("segment_id").alias("first"))
    null = lambda kind: F.lit(None).cast(kind)
    around = rows.join(_cited(s, d).where("pos = 7").select("text_id", F.col("segment_id").alias("eighth")), "text_id", "left").select(
        F.expr("2 * doc_id").alias("request_id"), "text_id", F.coalesce("eighth", F.lit("none")).alias("around"), F.lit(3).alias("window"),
        null("string").alias("range_start"), null("string").alias("range_end"), null("int").alias("offset"), null("int").alias("limit"),
    )
    page = rows.select(
        F.expr("2 * doc_id + 1").alias("request_id"), "text_id", null("string").alias("around"), null("int").alias("window"),
        null("string").alias("range_start"), null("string").alias("range_end"), F.lit(10).alias("offset"), F.lit(10).alias("limit"),
    )
    return around.union(page)


def _slices(s, d):
    rows, _ = texts.slices(_cited(s, d), _requests(s, d))
    return rows.select("request_id", "segment_id", "idx", "total", "offset", "returned", "has_more", "next_offset")


def _read_texts(s, d):
    rows, _ = texts.read_texts(_cited(s, d), _requests(s, d), {"root": "text", "other": "source"}, [], "root")
    return rows.select("request_id", "segment_id", "idx", F.md5("title").alias("title"), F.md5("text").alias("text"))


def _postings(s, d):
    return ingest.build_postings(_docs(s, d), "doc_id", ["text", "source"])


def _phrases(s, d):
    docs = _docs(s, d)
    size = F.size(folded_tokens(F.col("text"))) + F.size(folded_tokens(F.col("source")))
    return search.phrase_search(_postings(s, d), docs.select("doc_id", size.alias("size")), PHRASES, field="text")


def _terms(s):
    return definitions.term_table(s, DEFINED, PROSE)


def _scored(s, d):
    rows = definitions.scored_definitions(_cited(s, d), _terms(s), PROSE)
    return rows.select(
        "term", "segment_id", F.array_join("markers", ",").alias("markers"), "kind", "detail", "closer", F.col("distance").cast("long").alias("distance"),
        F.col("score").cast("long").alias("score"), "context",
    )


def _found(s, d):
    rows = definitions.find_definitions(_cited(s, d), DEFINED, PROSE, 6)
    return rows.select("term", F.col("rank").cast("long").alias("rank"), "segment_id", F.col("score").cast("long").alias("score"), "context", "duplicates", "detail", F.size("block").cast("long").alias("n_block"))


def _page(s, d):
    titles = texts.text_titles(_cited(s, d), ["text"])
    rows = definitions.definitions_page(_cited(s, d), DEFINED, PROSE, titles, 5, 2)
    return rows.select("term", "rank", "segment_id", "score", "context", "title")


def _near(s, d):
    near = search.semantic_topk(table(s, d, "embeddings"), list(ASKED), 20).select("query_id", F.col("vec_id").alias("id"), "distance")
    terms = s.createDataFrame([(q, t, c) for q, (t, c) in ASKED.items()], "query_id long, needle string, scope string")
    return survey.semantic_layer(near, _docs(s, d).select(F.col("doc_id").alias("id"), "text"), terms, 20)


def _report(s, d):
    words = _dictionary(s, d).select("word", F.expr("concat('src', item_id % 3)").alias("source"), F.md5("text").alias("text"))
    segs = segments(_docs(s, d)).select(F.col("doc_id").alias("text_id"), "pos", folded_tokens(F.col("segment")).alias("tokens"))
    return dictionary.word_report(WORDS, words, segs)


def _citations(s, d):
    rows = _cited(s, d)
    titles = texts.text_titles(rows, ["text"])
    sizes = rows.groupBy("text_id").agg(F.count("*").alias("size"), F.first("source").alias("source"), F.min_by("segment_id", "pos").alias("first"))
    joined = sizes.join(titles, "text_id", "left")
    cite = markup.citation(F.col("text_id"), F.lit(None).cast("string"), F.substr("text", F.lit(1), F.lit(20)), F.col("source"))
    template = F.when(F.col("size") > 5, F.lit("https://reader.example/{text}?at={rest}")).otherwise(F.lit("javascript:{text}"))
    return joined.select("text_id", "size", cite.alias("citation"), markup.deep_link("/read", F.col("text_id"), F.col("first"), template).alias("link"))


def _concepts(s, d):
    near = search.semantic_topk(table(s, d, "embeddings"), list(ASKED), 20).select("query_id", F.col("vec_id").alias("id"))
    words = F.create_map(*[F.lit(x) for q, (t, _) in ASKED.items() for x in (q, t)])
    held = F.filter(F.map_keys(words), lambda q: F.array_contains(folded_tokens(F.col("text")), F.element_at(words, q)))
    lexical = _docs(s, d).select(F.col("doc_id").alias("id"), F.explode(held).alias("query_id"))
    return survey.concept_only(near, lexical)


def _stems(s, d):
    rules = tuple((suffix, (vowel, "a")) for suffix, vowel, _ in PROSE_LEMMAS)
    rows = _dictionary(s, d).select("word").distinct()
    made = rows.select("word", dictionary.candidate_stems(F.col("word"), rules).alias("s"))
    return made.select("word", F.array_join("s.stems", ",").alias("stems"), F.array_join("s.suffixes", ",").alias("suffixes"))


def _upserted(s, d):
    docs = _docs(s, d).select("doc_id", "lang", "source")
    new = table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("lang"), F.col("turn").cast("string").alias("source"), F.col("turn").cast("long").alias("turn"))
    return ingest.upsert(docs, new, ["doc_id"], "turn", kept=("source",))


def _translated(s, d):
    columns = ["segment_id", "language", "edition", "translator", "text"]
    rows = _translations(s, d)
    base = rows.where("turn < 2").select(*columns)
    new = rows.select(*columns, "turn").withColumn("edition", F.lit("user")).withColumn("text", F.concat("text", F.lit("!")))
    out = ingest.upsert_translations(base, new, rows.where("edition = 'assistant'"), "turn")
    return out.select("segment_id", "edition", "translator", F.md5("text").alias("text"))


JOBS = {
    "assign_collection": lambda s, d: assign_collection(
        _cited(s, d).select("text_id", F.col("lang").alias("collection")).distinct(), (("en3", "chosen"), ("fr6", "chosen"), ("de7", "apart"))
    ),
    "upsert_segments": _upserted,
    "upsert_translations": _translated,
    "seed_dims": lambda s, d: ingest.seed_dims(table(s, d, "region").select("r_regionkey", "r_name"), [(1, "FIRST"), (90, "NEW"), (90, "NEWER")], "r_regionkey"),
    "glossary": lambda s, d: _entries(s, d).select("page_id", "entry", F.md5("word").alias("word"), F.md5("definition").alias("definition")),
    "load_dictionary": lambda s, d: ingest.dictionary_rows(
        _entries(s, d).select("word", F.col("definition").alias("text")), "pages", "xx", markup.without_tags
    ).select("word", "source", F.md5("text").alias("text")),
    "clean_html": lambda s, d: table(s, d, "pages").select("page_id", markup.clean_html(F.col("html")).alias("text")),
    "posting_statistics": lambda s, d: ingest.token_statistics(_docs(s, d), "doc_id", ["text", "source"]),
    "substring_requests": lambda s, d: needles.search_substrings(
        _cited(s, d).select("text_id", "pos", "text", "source"), table(s, d, "benchmark").select(F.col("item_id").alias("request_id"), F.expr("substr(text, 3, 9)").alias("needle")), ["text", "source"], ["text_id", "pos"]
    ).select("request_id", "rank", "text_id", "pos", "matched"),
    "any_token_requests": lambda s, d: needles.match_any_tokens(
        segments(_docs(s, d)), table(s, d, "benchmark").select(F.col("item_id").alias("request_id"), F.array_join(F.slice(F.split("text", " "), 2, 3), "-").alias("query")), ["segment", "source"], ["doc_id", "pos"]
    ),
    "survey_headwords": lambda s, d: survey.survey_totals(segments(_docs(s, d)), survey.term_table(s, _headwords(s, d))),
    "survey_phrases": lambda s, d: survey.survey_totals(segments(_docs(s, d)), survey.term_table(s, _two_words(s, d))),
    "related_requests": lambda s, d: search.related_words(
        search.vocabulary(_docs(s, d)), _dictionary(s, d).select(fold(F.expr("substr(word, 2, 4)")).alias("part")).where("part rlike '^[a-z0-9]{2,}$'")
    ),
    "natural_neighbours": lambda s, d: texts.natural_neighbours(
        _cited(s, d).select("text_id", "lang").distinct(), _cited(s, d).where("pos >= 3"), ["lang"]
    ).select("text_id", F.col("previous.text_id").alias("previous"), F.col("next.text_id").alias("next")),
    "phrase_search": _phrases,
    "export_texts": lambda s, d: texts.export_texts(
        _cited(s, d).select("text_id", "segment_id", "pos", "text"), _cited(s, d).select("text_id", "lang").distinct()
    ).select("text_id", F.md5("value").alias("value")),
    "align_languages": lambda s, d: texts.align_languages(
        _roots(s, d), {e: _translations(s, d).where(F.col("edition") == e).select("segment_id", "text") for e in ("assistant", "system")}
    ).select("segment_id", *[F.md5(c).alias(c) for c in ("text", "text_assistant", "text_system")]),
    "enabled_languages": lambda s, d: texts.enabled_languages(
        _docs(s, d).select("doc_id", F.md5("text").alias("text_a"), F.col("lang").alias("text_b"), F.col("source").alias("text_c")),
        {"a": "text_a", "b": "text_b", "c": "text_c"}, ["c"], "a",
    ),
    "with_hierarchy": _with_hierarchy,
    "filter_by_level": lambda s, d: _with_hierarchy(s, d).where(F.col("r_name") == "ASIA"),
    "structure_five": lambda s, d: texts.structure(_levels(s, d), _sizes(s, d)),
    "structure_nonempty": lambda s, d: texts.structure(_levels(s, d), _sizes(s, d).where("o_orderkey % 7 = 0"), empty=False),
    "filter_sources": lambda s, d: _cited(s, d).where(ids.in_sources(F.col("text_id"), ["en", "fr"])).groupBy(ids.book_prefix(F.col("text_id")).alias("book")).agg(F.count("*").alias("n")),
    "validate_ids": lambda s, d: texts.validate_ids(_cited(s, d).select("text_id").union(_cited(s, d).select("segment_id")))[0].groupBy("text_id").agg(F.count("*").alias("n")),
    "invalid_ids": lambda s, d: texts.validate_ids(_cited(s, d).select("text_id").union(_cited(s, d).select("segment_id")))[1].groupBy("text_id").agg(F.count("*").alias("n")),
    "id_parts": lambda s, d: _cited(s, d).select(
        "segment_id",
        ids.id_prefix(F.col("segment_id")).alias("prefix"),
        ids.id_rest(F.col("segment_id")).alias("rest"),
        ids.top_group(F.col("segment_id")).alias("grp"),
        ids.paragraph_key(F.col("segment_id")).alias("paragraph"),
        ids.stratum(F.col("text_id"), dict(PROSE.strata), PROSE.family, 2, 3).alias("stratum"),
    ),
    "decode_ids": lambda s, d: _cited(s, d).select("text_id").distinct().select("text_id", ids.decode_id(F.col("text_id"), NAMES, {"en": "text"}, {}, {}, "zz-").alias("name")),
    "match_any_token": lambda s, d: ingest.match_any_token(segments(_docs(s, d)), "zu nicht-Étion", ["segment", "source"]).select("doc_id", "pos"),
    "search_substring": lambda s, d: ingest.search_substring(_cited(s, d), "Étion", "text", "source", fold).select("text_id", "pos", "matched"),
    "union_hits": lambda s, d: ingest.union_hits(
        *[ingest.match_any_token(segments(_docs(s, d)), t, ["segment"]).select("doc_id", "pos") for t in ("nicht", "zuver", "nichten")]
    ),
    "pick_translator": lambda s, d: texts.pick_translator(
        _translations(s, d).drop("translator").withColumnRenamed("edition", "translator"), ["system", "assistant", "user"]
    )[0].groupBy("text_id", "translator").agg(F.count("*").alias("n")),
    "translators_used": lambda s, d: texts.pick_translator(
        _translations(s, d).drop("translator").withColumnRenamed("edition", "translator"), ["system", "assistant", "user"]
    )[1],
    "edition_text": lambda s, d: texts.edition_text(_roots(s, d).select("segment_id"), _translations(s, d), "assistant").select("segment_id", F.md5("edition_text").alias("text")),
    "translation_fallback": lambda s, d: texts.with_fallback(
        _roots(s, d).select("segment_id", F.when(F.col("turn") % 4 != 0, F.col("text")).alias("text")), _translations(s, d).where("edition != 'user'")
    ).select("segment_id", F.md5("shown").alias("shown"), "shown_edition"),
    "editions_of": lambda s, d: texts.editions_of(_roots(s, d), _translations(s, d).where("edition != 'user'")).select(
        "segment_id", F.md5(F.array_join(F.transform("editions", lambda e: F.concat(e["edition"], F.lit("|"), e["translator"], F.lit("|"), e["text"])), "#")).alias("editions"), "n_editions"
    ),
    "lookup_words": lambda s, d: dictionary.lookup_words(
        _docs(s, d).select(F.explode(dictionary.dictionary_tokens(F.col("text"))).alias("word")), _dictionary(s, d), PROSE_LEMMAS
    ),
    "dictionary_coverage": lambda s, d: dictionary.dictionary_coverage(_docs(s, d), _dictionary(s, d), PROSE_LEMMAS),
    "candidate_stems": _stems,
    "word_report": _report,
    "outline": lambda s, d: texts.outline(_cited(s, d)).withColumn("title", F.md5("title")),
    "text_titles": lambda s, d: texts.text_titles(
        _cited(s, d), ["text"], _cited(s, d).where("pos = 1 and doc_id % 5 = 0").select("text_id", "text")
    ).select("text_id", F.md5("text").alias("title")),
    "slices": _slices,
    "slices_rejected": lambda s, d: texts.slices(_cited(s, d), _requests(s, d))[1],
    "read_texts": _read_texts,
    "definition_scores": _scored,
    "find_definitions": _found,
    "definitions_page": _page,
    "paired_paragraphs": lambda s, d: definitions.paired_paragraphs(_cited(s, d), PROSE.opening, PROSE.answer).select("text_id", "paragraph", "segment_id"),
    "context_examples": lambda s, d: definitions.context_examples(_cited(s, d), _terms(s), PROSE).select("term", "segment_id"),
    "sentence_key": lambda s, d: _docs(s, d).select("doc_id", F.md5(definitions.sentence_key(F.col("text"))).alias("key")),
    "render_markup": lambda s, d: _cited(s, d).select(
        "text_id", "pos", F.md5(markup.render_markup(F.col("text"), F.array(F.lit("the"), F.lit("de")))).alias("html")
    ),
    "fuzzy_search": lambda s, d: search.fuzzy_search(segments(_docs(s, d)), ALIKE),
    "semantic_layer": lambda s, d: _near(s, d)[0],
    "semantic_summary": lambda s, d: _near(s, d)[1],
    "concept_only": _concepts,
    "embed_corpus": lambda s, d: search.embed_corpus(_docs(s, d).select(F.col("doc_id").alias("id"), "text"), table(s, d, "embeddings")),
    "table_counts": lambda s, d: texts.table_counts(
        {n: table(s, d, n) for n in ("documents", "conversations", "lineitem")} | {"with vector": table(s, d, "embeddings").where("embedding is not null")}
    ),
    "citations": _citations,
    "overlay": lambda s, d: texts.overlay_translations(_roots(s, d).select("segment_id"), _translations(s, d).where("turn = 3"))[0].select("segment_id", F.md5("given").alias("given")),
    "overlay_dropped": lambda s, d: texts.overlay_translations(_roots(s, d).where("turn < 2"), _translations(s, d).where("edition = 'user'"))[1].select("segment_id", F.md5("given").alias("given")),
    "order_rules": lambda s, d: texts.order_rules(_cited(s, d).where("trim(text) != ''")),
    "orphan_rules": lambda s, d: texts.orphan_rules({
        "vector without text": (table(s, d, "embeddings"), "vec_id", _docs(s, d), "doc_id"),
        "label without text": (table(s, d, "labels"), "doc_id", _docs(s, d), "doc_id"),
        "order without customer": (table(s, d, "orders"), "o_custkey", table(s, d, "customer"), "c_custkey"),
        "customer without order": (table(s, d, "customer"), "c_custkey", table(s, d, "orders"), "o_custkey"),
    }),
    "collection_pages": lambda s, d: _pages(s, d).select("r_name", "total", F.size("children").cast("long").alias("n_books"), F.md5(F.array_join(F.transform("children", lambda b: F.concat(
        b["n_name"], F.lit(":"), F.array_join(F.transform(b["children"], lambda t: t["c_name"]), ","))), ";")).alias("books")),
    "export_structure": lambda s, d: texts.export_documents(_pages(s, d), "r_name").select("r_name", F.md5("value").alias("value")),
    "corpus_rules": lambda s, d: texts.corpus_rules(_cited(s, d), _cited(s, d).select("text_id", F.lit(4).alias("n")).distinct()),
    "neighbours": lambda s, d: texts.neighbours(_docs(s, d), ["lang", "source"], "doc_id", 100).select("doc_id", "previous", "next"),
    "edition_stats": lambda s, d: catalog.edition_stats(_translations(s, d).select("edition", F.col("text_id").alias("conv_id"))),
}

_CIT = """seg AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS text,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
cit0 AS (SELECT *, coalesce(lang, 'xx') AS l, doc_id % 3 AS k FROM seg),
cit AS (SELECT CASE k WHEN 2 THEN l || doc_id || '-' || (doc_id + 9) ELSE l || doc_id END AS text_id,
  CASE k WHEN 0 THEN l || doc_id || ':' || (pos // 5) || '.' || (pos % 5) WHEN 1 THEN l || doc_id || ':' || (pos // 4) || '.' || (pos % 4 + 1)
  ELSE l || (doc_id + pos // 6) || ':1.' || (pos % 6 + 1) END AS segment_id, pos, text, lang, source, doc_id FROM cit0)"""
_TR = """tr AS (SELECT conv_id || ':' || (turn // 2) AS segment_id, conv_id AS text_id, role AS edition, 'by ' || role AS translator, text, turn FROM conversations)"""
_TOK = "regexp_extract_all(lower(strip_accents({})), '[a-z0-9]+')"
_STRIP = r"nullif(regexp_replace({}, '^\s+|\s+$', '', 'g'), '')"
_BLANKS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_BARE = r"replace(lower(regexp_replace(p, '^[^\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}]+$', '', 'g')), 'ṁ', 'ṃ')"
_DICT = rf"""known AS (SELECT DISTINCT {_BARE} AS word FROM (SELECT unnest(string_split_regex(text, '{_BLANKS}')) AS p FROM benchmark) WHERE length({_BARE}) >= 2)"""
_WORDS = rf"""tok AS (SELECT DISTINCT doc_id, {_BARE} AS word FROM (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '{_BLANKS}')) AS p FROM documents) WHERE length({_BARE}) >= 2)"""
_LEMMAS = ", ".join(f"({k + 1}, '{a}', '{b}', '{c}')" for k, (a, b, c) in enumerate(sorted(PROSE_LEMMAS, key=lambda r: -len(r[0]))))
_LOOKUP = f"""{_DICT}, {_WORDS}, asked AS (SELECT DISTINCT word FROM tok),
rules AS (SELECT * FROM (VALUES {_LEMMAS}) AS x(r, suffix, vowel, kase)),
ends AS (SELECT word, n, right(word, n) AS suffix FROM asked, (SELECT DISTINCT length(suffix) AS n FROM rules) WHERE length(word) >= n + 2),
tried AS (SELECT word, 0 AS r, word AS lemma, NULL::VARCHAR AS suffix, NULL::VARCHAR AS kase FROM asked
  UNION ALL SELECT word, r, left(word, length(word) - n) || vowel, suffix, kase FROM ends JOIN rules USING (suffix)),
best AS (SELECT word, min_by({{'lemma': lemma, 'suffix': suffix, 'kase': kase}}, r) AS m FROM tried WHERE lemma IN (SELECT word FROM known) GROUP BY 1),
looked AS (SELECT a.word, m.lemma AS entry, m.suffix AS suffix, m.kase AS "case" FROM asked a LEFT JOIN best b ON a.word = b.word)"""


def _plain(c: str) -> str:
    """Twin of ``without_tags``."""
    t = rf"regexp_replace(regexp_replace({c}, '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]*>', ' ', 'g')"
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        t = f"replace({t}, '{entity}', '{sign}')"
    t = rf"regexp_replace({t}, '[ \t\r]+', ' ', 'g')"
    return rf"regexp_replace(regexp_replace(regexp_replace({t}, ' ?\n ?', chr(10), 'g'), '\n{{2,}}', chr(10), 'g'), '^\s+|\s+$', '', 'g')"


_ENTRIES = rf"""parts AS (SELECT page_id, unnest(string_split_regex(html, '(?i)<b>')) AS part, generate_subscripts(string_split_regex(html, '(?i)<b>'), 1) - 1 AS entry FROM pages),
cut AS (SELECT page_id, entry, regexp_extract(part, '(?is)^(.*?)<br\s*/?>', 1) AS w, regexp_extract(part, '(?is)^.*?<br\s*/?>(.*)$', 1) AS t FROM parts WHERE entry > 0 AND regexp_matches(part, '(?i)<br\s*/?>')),
entries AS (SELECT page_id, entry, {_plain("w")} AS word, {_plain("t")} AS definition FROM cut), glossary AS (SELECT * FROM entries WHERE word <> '' AND definition <> '')"""


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _begins(x: str, beginnings) -> str:
    return "(" + " OR ".join(f"starts_with({x}, '{b}')" for b in beginnings) + ")"


def _gap(beginnings) -> str:
    """Twin of ``min_token_distance`` within the proximity."""
    a = "list_filter(range(1, len(t) + 1), lambda i: list_contains(forms, t[i]))"
    b = f"list_filter(range(1, len(t) + 1), lambda i: {_begins('t[i]', beginnings)} AND NOT list_contains({_list(PROSE.false_markers)}, t[i]))"
    return f"list_min(list_filter(flatten(list_transform({a}, lambda x: list_transform({b}, lambda y: abs(x - y)))), lambda z: z <= {PROSE.proximity}))"


def _forms_sql() -> str:
    rows = []
    for t in DEFINED:
        stem = t.endswith("a") and len(t) > 2
        make = lambda a, b: [(t[:-1] if stem else t) + e for e in (a if stem else b)]  # noqa: E731, B023
        f = list(dict.fromkeys([t, *make(PROSE.stem_endings, PROSE.other_endings)]))
        rows.append(f"('{t}', {_list(f)}, {_list(make(PROSE.oblique_stem, PROSE.oblique_other))}, {_list(make(PROSE.genitive_stem, PROSE.genitive_other))})")
    return "terms AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") AS x(term, forms, oblique, genitive))"


_STRATA = "CASE " + " ".join(f"WHEN book = '{b}' THEN {n}" for b, n in PROSE.strata) + f" WHEN starts_with(book, '{PROSE.family}') THEN 2 ELSE 3 END"
_SCORED = f"""{_CIT}, {_forms_sql()},
tok AS (SELECT text_id, segment_id, pos, text, {_TOK.format("text")} AS t, regexp_extract(text_id, '^[^0-9]*') AS book,
  regexp_replace(segment_id, '\\.[^.]*$', '') AS paragraph FROM cit),
present AS (SELECT *, list_filter(list_distinct(t), lambda x: list_contains(forms, x)) AS p FROM tok, terms WHERE list_has_any(t, forms)),
allowed AS (SELECT *, list_contains(t, '{PROSE.question_word}') AND len(list_filter(t, lambda x: starts_with(x, '{PROSE.question_pair}'))) > 0 AS pair FROM present
  WHERE len(list_filter(p, lambda x: NOT list_contains(oblique, x))) > 0
  AND (len(list_filter(p, lambda x: NOT list_contains(oblique, x) AND NOT list_contains(genitive, x))) > 0 OR len(list_filter(t, lambda x: starts_with(x, '{PROSE.designation}'))) > 0)),
marked AS (SELECT *, CASE WHEN pair THEN {_gap((*PROSE.interrogative, PROSE.question_pair))} ELSE {_gap(PROSE.interrogative)} END AS ask,
  {_gap(PROSE.predicate)} AS say, {_gap(PROSE.simile)} AS lik,
  len(list_filter(range(2, len(t) + 1), lambda i: t[i] = '{PROSE.named}' AND list_contains(forms, t[i - 1]))) > 0 AS beside,
  len(list_filter(range(1, len(t)), lambda i: list_contains({_list(PROSE.demonstratives)}, t[i]) AND starts_with(t[i + 1], '{PROSE.closing}')
    AND list_has_any(t[i + 2:i + 1 + {PROSE.closer_window}], forms))) > 0 AS closer FROM allowed),
classed AS (SELECT term, text_id, segment_id, pos, text, book,
  array_to_string(list_filter([CASE WHEN ask IS NOT NULL THEN 'interrogative' END, CASE WHEN say IS NOT NULL THEN 'predicate' END, CASE WHEN beside THEN 'named' END, CASE WHEN lik IS NOT NULL THEN 'simile' END], lambda x: x IS NOT NULL), ',') AS markers,
  CASE WHEN ask IS NOT NULL OR say IS NOT NULL OR beside THEN 'direct' ELSE 'simile' END AS kind,
  CASE WHEN list_has_any(t, {_list(PROSE.numerals)}) THEN 'enumerative' ELSE 'descriptive' END AS detail, closer,
  least(ask, say, lik, CASE WHEN beside THEN 1 END) AS distance, false AS context FROM marked WHERE ask IS NOT NULL OR say IS NOT NULL OR lik IS NOT NULL OR beside),
sim AS (SELECT text_id, paragraph, segment_id, pos, text, t, book, len(list_filter(t, lambda x: starts_with(x, '{PROSE.opening}'))) > 0 AS o,
  len(list_filter(t, lambda x: starts_with(x, '{PROSE.answer}'))) > 0 AS c FROM tok),
pairs AS (SELECT * FROM sim WHERE o AND (text_id, paragraph) IN (SELECT (text_id, paragraph) FROM sim WHERE c)),
firsts AS (SELECT DISTINCT term, text_id, paragraph FROM tok, terms WHERE ends_with(segment_id, '.1') AND list_has_any(t, forms)),
ctx AS (SELECT f.term, p.text_id, p.segment_id, p.pos, p.text, p.book, 'simile' AS markers, 'simile' AS kind, 'descriptive' AS detail, false AS closer, {PROSE.proximity} AS distance, true AS context
  FROM pairs p JOIN firsts f USING (text_id, paragraph) JOIN terms USING (term) WHERE NOT list_has_any(p.t, forms)),
both_ AS (SELECT * FROM classed UNION ALL SELECT * FROM ctx),
scored AS (SELECT *, {_STRATA} AS stratum, ((CASE WHEN contains(markers, 'predicate') THEN 100 ELSE 0 END) + (CASE WHEN contains(markers, 'interrogative') THEN 90 ELSE 0 END)
  + (CASE WHEN contains(markers, 'named') THEN 85 ELSE 0 END) + (CASE WHEN kind = 'simile' THEN 40 ELSE 0 END) + (CASE WHEN detail = 'descriptive' THEN 25 ELSE -5 END)
  + (CASE WHEN list_contains({_list(PROSE.listed)}, string_split(segment_id, ':')[1]) THEN 15 ELSE 0 END) + greatest(0, {PROSE.proximity} - distance)
  + (CASE WHEN closer THEN {PROSE.closer_bonus} ELSE 0 END) + {_list(PROSE.penalties).replace("'", "")}[({_STRATA}) + 1])::BIGINT AS score FROM both_)"""
_FOUND = f"""{_SCORED}, grp AS (SELECT *, count(*) OVER (PARTITION BY term, lower(strip_accents(text))) - 1 AS duplicates,
  row_number() OVER (PARTITION BY term, lower(strip_accents(text)) ORDER BY score DESC, stratum, text_id, segment_id) AS r FROM scored),
uniq AS (SELECT *, row_number() OVER (PARTITION BY term, context ORDER BY score DESC, stratum, text_id, segment_id) AS own, least(2, count(*) FILTER (context) OVER (PARTITION BY term)) AS held FROM grp WHERE r = 1),
top AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, stratum, text_id, segment_id) AS rank FROM uniq WHERE CASE WHEN context THEN own <= held ELSE own <= 6 - held END),
blk AS (SELECT top.term, top.rank, count(*) AS n_block, bool_or(list_has_any(c.t, {_list(PROSE.numerals)})) AS lists FROM top JOIN tok c ON c.text_id = top.text_id AND c.pos BETWEEN
  top.pos - CASE WHEN contains(markers, 'predicate') THEN 10 WHEN contains(markers, 'named') THEN 1 WHEN contains(markers, 'interrogative') THEN 2 ELSE 4 END AND
  top.pos + CASE WHEN contains(markers, 'predicate') THEN 2 WHEN contains(markers, 'named') THEN 8 WHEN contains(markers, 'interrogative') THEN 10 ELSE 4 END GROUP BY 1, 2)"""
_TITLES = rf"""titles AS (SELECT text_id, CASE WHEN x <> '~' THEN x END AS title FROM (SELECT text_id, {_STRIP.format("arg_max(coalesce(text, ''), pos)")} AS x FROM cit
  WHERE regexp_matches(segment_id, ':0\.[0-9]+$') GROUP BY 1))"""
_REQ = f"""{_CIT}, num AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY pos, segment_id) - 1 AS idx, count(*) OVER (PARTITION BY text_id) AS total FROM cit),
req AS (SELECT 2 * doc_id AS request_id, text_id, greatest(0, 4) AS start, least(total, 11) AS stop, total FROM num WHERE pos = 7
  UNION ALL SELECT 2 * doc_id + 1, text_id, least(10, total), least(total, least(10, total) + 10), total FROM num WHERE pos = 0)"""
_NEARBY = f"""vec AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
near AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_distance(q.e, v.e), 4) AS distance FROM vec q, vec v WHERE q.vec_id IN ({", ".join(map(str, ASKED))})),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM near WHERE distance <= 1 QUALIFY rank <= 20),
lex AS (SELECT top.query_id, top.id, top.distance, len(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}_]+'), lambda w: lower(strip_accents(w))),
  lambda w: CASE WHEN q.scope = 'word' THEN w = q.needle ELSE starts_with(w, q.needle) END)) > 0 AS in_lexical
  FROM top JOIN documents d ON d.doc_id = top.id JOIN (VALUES {", ".join(f"({q}, '{t}', '{c}')" for q, (t, c) in ASKED.items())}) AS q(query_id, needle, scope) ON q.query_id = top.query_id)"""
_CHAIN = """sz AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'R' GROUP BY 1)"""

JOBS_SQL = {
    "assign_collection": f"""WITH {_CIT} SELECT DISTINCT text_id, CASE text_id WHEN 'en3' THEN 'chosen' WHEN 'fr6' THEN 'chosen' WHEN 'de7' THEN 'apart' ELSE lang END AS collection FROM cit""",
    "upsert_segments": """WITH n AS (SELECT conv_id AS doc_id, role AS lang, turn::VARCHAR AS source FROM conversations
        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) = 1)
        SELECT doc_id, coalesce(n.lang, d.lang) AS lang, CASE WHEN d.doc_id IS NULL THEN n.source ELSE d.source END AS source FROM documents d FULL JOIN n USING (doc_id)""",
    "upsert_translations": f"""WITH {_TR}, n AS (SELECT segment_id, 'user' AS edition, translator, text || '!' AS text FROM tr WHERE segment_id IN (SELECT segment_id FROM tr WHERE edition = 'assistant')
        QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY turn DESC, translator DESC, text DESC) = 1), b AS (SELECT * FROM tr WHERE turn < 2)
        SELECT segment_id, edition, CASE WHEN n.text IS NOT NULL THEN n.translator ELSE b.translator END AS translator, md5(coalesce(n.text, b.text)) AS text FROM b FULL JOIN n USING (segment_id, edition)""",
    "seed_dims": """SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'FIRST' ELSE r_name END AS r_name FROM region UNION ALL SELECT 90, 'NEWER'""",
    "glossary": f"WITH {_ENTRIES} SELECT page_id, entry::INT AS entry, md5(word) AS word, md5(definition) AS definition FROM glossary",
    "load_dictionary": f"WITH {_ENTRIES} SELECT lower(word) AS word, 'pages' AS source, md5({_plain('definition')}) AS text FROM glossary",
    "posting_statistics": f"""SELECT token, count(DISTINCT doc_id) AS df, count(*) AS n FROM (SELECT doc_id, unnest({_TOK.format("text")}) AS token FROM documents
        UNION ALL SELECT doc_id, unnest({_TOK.format("source")}) FROM documents) GROUP BY 1""",
    "order_rules": f"""WITH {_CIT}, o AS (SELECT text_id, pos, list_transform(regexp_extract_all(segment_id, '[0-9]+'), lambda x: x::BIGINT) AS k FROM cit WHERE trim(text) <> ''),
        w AS (SELECT pos, k, lag(pos) OVER x AS p, lag(k) OVER x AS pk FROM o WINDOW x AS (PARTITION BY text_id ORDER BY pos))
        SELECT 'first place isn''t 0' AS rule, count(*) FILTER (p IS NULL AND pos <> 0) AS n FROM w UNION ALL
        SELECT 'gap before the place', count(*) FILTER (pos - p > 1) FROM w UNION ALL SELECT 'id not above the one before', count(*) FILTER (k <= pk) FROM w""",
    "orphan_rules": """SELECT 'vector without text' AS rule, count(*) AS n FROM embeddings ANTI JOIN documents ON vec_id = documents.doc_id UNION ALL
        SELECT 'label without text', count(*) FROM labels ANTI JOIN documents ON labels.doc_id = documents.doc_id UNION ALL
        SELECT 'order without customer', count(*) FROM orders ANTI JOIN customer ON o_custkey = c_custkey UNION ALL
        SELECT 'customer without order', count(*) FROM customer ANTI JOIN orders ON o_custkey = c_custkey""",
    "export_structure": """WITH t AS (SELECT c_nationkey, list({'c_custkey': c_custkey, 'c_name': c_name} ORDER BY c_custkey) AS t, count(*) AS n FROM customer GROUP BY 1),
        b AS (SELECT n_regionkey, list({'n_nationkey': n_nationkey, 'n_name': n_name, 'children': t, 'total': n} ORDER BY n_nationkey) AS b, sum(n)::BIGINT AS n FROM nation JOIN t ON c_nationkey = n_nationkey GROUP BY 1)
        SELECT r_name, md5(to_json({'r_regionkey': r_regionkey, 'r_name': r_name, 'children': b, 'total': n})::VARCHAR) AS value FROM region JOIN b ON n_regionkey = r_regionkey""",
    "collection_pages": """WITH b AS (SELECT n_regionkey, n_nationkey, n_name, count(*) AS c, string_agg(c_name, ',' ORDER BY c_custkey) AS t
          FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)
        SELECT r_name, sum(c)::BIGINT AS total, count(*) AS n_books, md5(string_agg(n_name || ':' || t, ';' ORDER BY n_nationkey)) AS books FROM region JOIN b ON n_regionkey = r_regionkey GROUP BY 1""",
    "substring_requests": f"""WITH {_CIT}, asked AS (SELECT item_id AS request_id, regexp_replace(lower(strip_accents(substr(text, 3, 9))), '^\\s+|\\s+$', '', 'g') AS needle FROM benchmark),
        hit AS (SELECT request_id, text_id, pos, CASE WHEN contains(lower(strip_accents(text)), needle) THEN 'text' ELSE 'source' END AS matched FROM cit JOIN asked
          ON contains(lower(strip_accents(text)), needle) OR contains(lower(strip_accents(coalesce(source, ''))), needle) WHERE length(needle) >= 3),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY text_id, pos) AS rank FROM hit)
        SELECT request_id, rank::INT AS rank, text_id, pos::INT AS pos, matched FROM ranked WHERE rank <= 50""",
    "any_token_requests": f"""WITH {_CIT}, q AS (SELECT item_id AS request_id, lower(trim(array_to_string(string_split(text, ' ')[2:4], '-'))) AS q FROM benchmark),
        tok AS (SELECT request_id, q, list_filter(string_split_regex(q, '[\\s\\-]+'), lambda t: length(t) >= 3) AS ts FROM q),
        asked AS (SELECT DISTINCT request_id, unnest(CASE WHEN len(ts) > 0 THEN ts ELSE [q] END) AS t FROM tok WHERE q <> ''),
        needle AS (SELECT DISTINCT t FROM asked),
        hit AS (SELECT doc_id, pos, t FROM cit JOIN needle ON contains(lower(text), t) OR contains(lower(coalesce(source, '')), t))
        SELECT DISTINCT request_id, doc_id, pos::INT AS pos FROM hit JOIN asked USING (t)""",
    "survey_headwords": f"""WITH {_CIT}, {_DICT}, terms AS (SELECT word AS term, scope, lower(strip_accents(word)) AS needle FROM known, (VALUES ('word'), ('stem')) AS x(scope) WHERE NOT contains(word, ' ')),
        tok AS (SELECT DISTINCT doc_id, pos, t FROM (SELECT doc_id, pos, unnest({_TOK.format("text")}) AS t FROM cit)),
        voc AS (SELECT DISTINCT t FROM tok),
        found AS (SELECT term, scope, t FROM voc JOIN terms ON scope = 'word' AND t = needle UNION ALL
          SELECT term, scope, t FROM voc JOIN terms ON scope = 'stem' AND needle <> '' AND starts_with(t, needle)),
        hits AS (SELECT DISTINCT term, scope, doc_id, pos FROM tok JOIN found USING (t))
        SELECT terms.term, terms.scope, count(h.pos) AS total_segments, count(DISTINCT h.doc_id) AS total_texts FROM terms LEFT JOIN hits h ON terms.term = h.term AND terms.scope = h.scope GROUP BY 1, 2""",
    "survey_phrases": f"""WITH {_CIT}, w AS (SELECT string_split(text, ' ') AS w FROM benchmark),
        terms AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] AS term FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w)),
        needle AS (SELECT term, lower(strip_accents(term)) AS n FROM terms), f AS (SELECT doc_id, pos, lower(strip_accents(text)) AS f FROM cit),
        hits AS (SELECT term, doc_id, count(*) AS c FROM f JOIN needle ON contains(f, n) GROUP BY 1, 2)
        SELECT terms.term, 'word' AS scope, coalesce(sum(c), 0)::BIGINT AS total_segments, count(h.doc_id) AS total_texts FROM terms LEFT JOIN hits h ON terms.term = h.term GROUP BY 1""",
    "related_requests": f"""WITH {_DICT}, voc AS (SELECT DISTINCT token FROM (SELECT unnest({_TOK.format("text")}) AS token FROM documents)),
        part AS (SELECT DISTINCT lower(strip_accents(substr(word, 2, 4))) AS part FROM known WHERE regexp_full_match(lower(strip_accents(substr(word, 2, 4))), '[a-z0-9]{{2,}}')),
        hit AS (SELECT part, token, row_number() OVER (PARTITION BY part ORDER BY length(token), token) AS rank FROM voc JOIN part ON contains(token, part) AND token <> part)
        SELECT part, token, rank::INT AS rank FROM hit WHERE rank <= 10""",
    "natural_neighbours": f"""WITH {_CIT}, t AS (SELECT DISTINCT text_id, lang, doc_id FROM cit WHERE pos >= 3)
        SELECT text_id, lag(text_id) OVER w AS previous, lead(text_id) OVER w AS next FROM t WINDOW w AS (PARTITION BY lang ORDER BY doc_id)""",
    "phrase_search": f"""WITH t AS (SELECT doc_id, {_TOK.format("text")} AS t, len({_TOK.format("text")}) + len({_TOK.format("source")}) AS size FROM documents),
        q AS (SELECT query, string_split(query, ' ') AS w FROM (VALUES {", ".join(f"('{p}')" for p in PHRASES)}) AS x(query)),
        tf AS (SELECT query, doc_id, size, len(list_filter(range(1, len(t)), lambda i: t[i] = w[1] AND t[i + 1] = w[2])) AS tf FROM t, q),
        m AS (SELECT count(*) AS n, avg(size) AS mean FROM t), f AS (SELECT *, count(*) OVER (PARTITION BY query) AS df FROM tf WHERE tf > 0),
        s AS (SELECT query, doc_id, round(greatest(ln((n - df + 0.5) / (df + 0.5)), {search.LEAST_IDF}) * tf * {search.K1 + 1} / (tf + {search.K1} * (1 - {search.B} + {search.B} * size / mean)), 4) AS score FROM f, m)
        SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""",
    "align_languages": f"""WITH {_TR}, o AS (SELECT segment_id, edition, min({_STRIP.format("text")}) AS text FROM tr GROUP BY 1, 2)
        SELECT r.segment_id, md5({_STRIP.format("r.text")}) AS text, md5(a.text) AS text_assistant, md5(s.text) AS text_system FROM tr r
        LEFT JOIN o a ON a.segment_id = r.segment_id AND a.edition = 'assistant' LEFT JOIN o s ON s.segment_id = r.segment_id AND s.edition = 'system'
        WHERE r.edition = 'user' AND {_STRIP.format("r.text")} IS NOT NULL""",
    "enabled_languages": "SELECT doc_id, md5(text) AS text_a, source AS text_c FROM documents",
    "with_hierarchy": """SELECT r_name, n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
    "filter_by_level": """SELECT r_name, n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1, 2""",
    "structure_five": f"""WITH {_CHAIN} SELECT r_regionkey, n_nationkey, count(o_orderkey) AS n_texts, coalesce(sum(n), 0)::BIGINT AS n_segments, coalesce(sum(n), 0) > 0 AS active
        FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN sz ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "structure_nonempty": f"""WITH {_CHAIN} SELECT r_regionkey, n_nationkey, count(o_orderkey) AS n_texts, sum(n)::BIGINT AS n_segments, true AS active
        FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN sz ON l_orderkey = o_orderkey WHERE l_orderkey % 7 = 0 GROUP BY 1, 2""",
    "filter_sources": f"WITH {_CIT} SELECT regexp_extract(text_id, '^[^0-9]*') AS book, count(*) AS n FROM cit WHERE regexp_extract(text_id, '^[^0-9]*') IN ('en', 'fr') GROUP BY 1",
    "validate_ids": f"WITH {_CIT} SELECT text_id, count(*) AS n FROM cit WHERE regexp_matches(text_id, '{ids.TEXT_ID}') GROUP BY 1",
    "invalid_ids": f"WITH {_CIT}, x AS (SELECT text_id FROM cit UNION ALL SELECT segment_id FROM cit) SELECT text_id, count(*) AS n FROM x WHERE NOT regexp_matches(text_id, '{ids.TEXT_ID}') GROUP BY 1",
    "id_parts": rf"""WITH {_CIT} SELECT segment_id, string_split(segment_id, ':')[1] AS prefix, string_split(segment_id, ':')[2] AS rest, string_split(string_split(segment_id, ':')[2], '.')[1] AS grp,
        regexp_replace(segment_id, '\.[^.]*$', '') AS paragraph, {_STRATA} AS stratum FROM (SELECT *, regexp_extract(text_id, '^[^0-9]*') AS book FROM cit)""",
    "decode_ids": f"""WITH {_CIT}, t AS (SELECT DISTINCT text_id, regexp_extract(text_id, '^[a-z]+') AS b, regexp_extract(text_id, '[0-9-]+$') AS n FROM cit)
        SELECT text_id, CASE WHEN b NOT IN ('en', 'de', 'fr') THEN text_id ELSE CASE b WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE 'French' END || ' · ' ||
        CASE WHEN contains(n, '-') THEN 'verses ' || replace(n, '-', '–') WHEN b = 'en' THEN 'text ' || n ELSE 'sutta ' || n END END AS name FROM t""",
    "match_any_token": f"WITH {_CIT} SELECT doc_id, pos::INT AS pos FROM cit WHERE contains(lower(text), 'nicht') OR contains(lower(text), 'étion') OR contains(lower(source), 'nicht') OR contains(lower(source), 'étion')",
    "search_substring": f"""WITH {_CIT} SELECT text_id, pos::INT AS pos, 'text' AS matched FROM cit WHERE contains(lower(strip_accents(text)), 'etion') ORDER BY text_id, pos LIMIT 50""",
    "union_hits": f"WITH {_CIT} SELECT DISTINCT doc_id, pos::INT AS pos FROM cit WHERE contains(lower(text), 'nicht') OR contains(lower(text), 'zuver')",
    "pick_translator": """WITH f AS (SELECT conv_id, CASE WHEN bool_or(role = 'system') THEN 'system' WHEN bool_or(role = 'assistant') THEN 'assistant' ELSE 'user' END AS role FROM conversations GROUP BY 1)
        SELECT conv_id AS text_id, role AS translator, count(*) AS n FROM conversations JOIN f USING (conv_id, role) GROUP BY 1, 2""",
    "translators_used": """SELECT role AS translator, count(*) AS n_texts FROM (SELECT conv_id, CASE WHEN bool_or(role = 'system') THEN 'system' WHEN bool_or(role = 'assistant') THEN 'assistant' ELSE 'user' END AS role FROM conversations GROUP BY 1) GROUP BY 1""",
    "edition_text": f"WITH {_TR} SELECT r.segment_id, md5(a.text) AS text FROM tr r LEFT JOIN (SELECT segment_id, min(text) AS text FROM tr WHERE edition = 'assistant' GROUP BY 1) a USING (segment_id) WHERE r.edition = 'user'",
    "translation_fallback": f"""WITH {_TR}, f AS (SELECT segment_id, edition, text FROM tr WHERE edition <> 'user' AND {_STRIP.format("text")} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY edition, text) = 1)
        SELECT r.segment_id, md5(CASE WHEN turn % 4 <> 0 AND {_STRIP.format("r.text")} IS NOT NULL THEN r.text ELSE f.text END) AS shown, CASE WHEN turn % 4 = 0 OR {_STRIP.format("r.text")} IS NULL THEN f.edition END AS shown_edition
        FROM tr r LEFT JOIN f USING (segment_id) WHERE r.edition = 'user'""",
    "editions_of": f"""WITH {_TR}, e AS (SELECT segment_id, string_agg(edition || '|' || translator || '|' || text, '#' ORDER BY edition, translator, text) AS s, count(*) AS n FROM tr WHERE edition <> 'user' GROUP BY 1)
        SELECT r.segment_id, md5(coalesce(s, '')) AS editions, coalesce(n, 0)::INT AS n_editions FROM tr r LEFT JOIN e USING (segment_id) WHERE r.edition = 'user'""",
    "lookup_words": f"WITH {_LOOKUP} SELECT * FROM looked",
    "dictionary_coverage": f"""WITH {_LOOKUP} SELECT doc_id, count(*) AS n_words, count(*) FILTER (entry IS NOT NULL AND suffix IS NULL) AS n_direct, count(*) FILTER (suffix IS NOT NULL) AS n_lemma
        FROM tok JOIN looked USING (word) GROUP BY 1""",
    "candidate_stems": f"""WITH {_DICT}, rules AS (SELECT suffix, vowel FROM (VALUES {_LEMMAS}) AS x(r, suffix, vowel, kase)),
        m AS (SELECT word, suffix, left(word, length(word) - length(suffix)) AS base, vowel FROM known JOIN rules ON ends_with(word, suffix) AND length(word) > length(suffix) + 1),
        s AS (SELECT word, word AS stem FROM known UNION SELECT word, base || vowel FROM m UNION SELECT word, base || 'a' FROM m)
        SELECT word, string_agg(DISTINCT stem, ',' ORDER BY stem) AS stems, coalesce((SELECT string_agg(DISTINCT suffix, ',' ORDER BY suffix) FROM m WHERE m.word = s.word), '') AS suffixes FROM s GROUP BY 1""",
    "outline": rf"""WITH {_CIT}, n AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY pos, segment_id) - 1 AS idx, string_split(segment_id, ':')[1] AS prefix, string_split(string_split(segment_id, ':')[2], '.')[1] AS grp0,
          ends_with(string_split(segment_id, ':')[2], '.0') AS h FROM cit),
        k AS (SELECT *, bool_or(h) OVER w AS headed, CASE WHEN min(prefix) OVER w <> max(prefix) OVER w THEN prefix ELSE grp0 END AS k FROM n WINDOW w AS (PARTITION BY text_id)),
        c AS (SELECT *, CASE WHEN headed THEN h ELSE k IS DISTINCT FROM lag(k) OVER (PARTITION BY text_id ORDER BY idx) OR idx = 0 END AS c FROM k),
        s AS (SELECT *, greatest(sum(c::INT) OVER (PARTITION BY text_id ORDER BY idx), 1)::BIGINT AS section FROM c)
        SELECT text_id, section, CASE WHEN bool_or(headed) THEN section::VARCHAR ELSE arg_min(k, idx) END AS key, CASE WHEN bool_or(headed) THEN arg_min(grp0, idx) FILTER (h) ELSE arg_min(k, idx) END AS grp,
          md5(arg_min(text, idx) FILTER (h)) AS title, arg_min(segment_id, idx) FILTER (h) AS header_segment_id, arg_min(segment_id, idx) AS first_segment_id, arg_max(segment_id, idx) AS last_segment_id,
          min(idx) AS "offset", count(*) AS segment_count FROM s GROUP BY 1, 2""",
    "text_titles": rf"""WITH {_CIT}, {_TITLES}, own AS (SELECT text_id, {_STRIP.format("text")} AS x FROM cit WHERE pos = 1 AND doc_id % 5 = 0)
        SELECT text_id, md5(coalesce(CASE WHEN x <> '~' THEN x END, title)) AS title FROM titles FULL JOIN own USING (text_id)""",
    "slices": f"""WITH {_REQ} SELECT request_id, segment_id, idx, r.total, start AS "offset", stop - start AS returned, stop < r.total AS has_more, CASE WHEN stop < r.total THEN stop END AS next_offset
        FROM req r JOIN num n ON n.text_id = r.text_id AND idx >= start AND idx < stop""",
    "slices_rejected": f"""WITH {_REQ} SELECT 2 * doc_id AS request_id, text_id, 'unknown segment' AS error FROM num WHERE pos = 0 AND text_id NOT IN (SELECT text_id FROM num WHERE pos = 7)""",
    "read_texts": f"""WITH {_REQ}, {_TITLES} SELECT request_id, segment_id, idx, md5(title) AS title, md5(text) AS text FROM req r JOIN num n ON n.text_id = r.text_id AND idx >= start AND idx < stop LEFT JOIN titles t ON t.text_id = r.text_id""",
    "definition_scores": f"WITH {_SCORED} SELECT term, segment_id, markers, kind, detail, closer, distance::BIGINT AS distance, score, context FROM scored",
    "find_definitions": f"WITH {_FOUND} SELECT term, rank, segment_id, score, context, duplicates, CASE WHEN lists THEN 'enumerative' ELSE 'descriptive' END AS detail, n_block FROM top JOIN blk USING (term, rank)",
    "paired_paragraphs": f"WITH {_SCORED} SELECT text_id, paragraph, segment_id FROM pairs",
    "context_examples": f"WITH {_SCORED} SELECT term, segment_id FROM ctx",
    "sentence_key": f"""SELECT doc_id, md5(array_to_string(CASE WHEN t[len(t)] = 'ti' THEN t[1:len(t) - 1] ELSE t END, ' ')) AS key FROM (SELECT doc_id, {_TOK.format("coalesce(text, '')")} AS t FROM documents)""",
    "semantic_layer": f"WITH {_NEARBY} SELECT id, query_id, distance, in_lexical FROM lex",
    "semantic_summary": f"WITH {_NEARBY} SELECT query_id, count(*) AS returned, count(*) FILTER (NOT in_lexical) AS new_finds, count(*) >= 20 AS capped FROM lex GROUP BY 1",
    "concept_only": f"""WITH {_NEARBY} SELECT query_id, id FROM top WHERE NOT EXISTS (SELECT 1 FROM documents d JOIN (VALUES {", ".join(f"({q}, '{t}')" for q, (t, _) in ASKED.items())}) AS q(qid, w)
        ON qid = query_id WHERE d.doc_id = id AND list_contains({_TOK.format("text")}, w))""",
    "table_counts": """SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'conversations', count(*) FROM conversations
        UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'with vector', count(*) FROM embeddings WHERE embedding IS NOT NULL""",
    "citations": rf"""WITH {_CIT}, {_TITLES}, z AS (SELECT text_id, count(*) AS size, min(source) AS source, arg_min(segment_id, pos) AS f FROM cit GROUP BY 1)
        SELECT text_id, size, CASE WHEN coalesce(left(title, 20), '') <> '' THEN left(title, 20) || ' (' || text_id || ', ' || upper(text_id) || '), ' ELSE text_id || ' (' || upper(text_id) || '), ' END || coalesce(source, '') AS citation,
        CASE WHEN size > 5 THEN 'https://reader.example/' || text_id || '?at=' || string_split(f, ':')[2] ELSE '/read/' || text_id || '#' || f END AS link FROM z LEFT JOIN titles USING (text_id)""",
    "overlay": f"WITH {_TR} SELECT r.segment_id, md5(g.text) AS given FROM tr r LEFT JOIN (SELECT segment_id, min(text) AS text FROM tr WHERE turn = 3 GROUP BY 1) g USING (segment_id) WHERE r.edition = 'user'",
    "overlay_dropped": f"WITH {_TR} SELECT segment_id, md5(min(text)) AS given FROM tr WHERE edition = 'user' AND segment_id NOT IN (SELECT segment_id FROM tr WHERE edition = 'user' AND turn < 2) GROUP BY 1",
    "corpus_rules": rf"""WITH {_CIT} SELECT 'null segment id' AS rule, count(*) FILTER (segment_id IS NULL) AS n FROM cit
        UNION ALL SELECT 'text id not by the grammar', count(*) FILTER (NOT regexp_matches(text_id, '{ids.TEXT_ID}')) FROM cit UNION ALL SELECT 'segment of another book', 0
        UNION ALL SELECT 'segment id without a number', count(*) FILTER (NOT contains(segment_id, ':')) FROM cit
        UNION ALL SELECT 'repeated segment id', count(*) FROM (SELECT segment_id FROM cit GROUP BY 1 HAVING count(*) > 1)
        UNION ALL SELECT 'repeated place', count(*) FROM (SELECT text_id, pos FROM cit GROUP BY 1, 2 HAVING count(*) > 1)
        UNION ALL SELECT 'smaller than expected', count(*) FROM (SELECT text_id FROM cit GROUP BY 1 HAVING count(*) < 4)""",
    "neighbours": """SELECT doc_id, lag(doc_id) OVER w AS previous, lead(doc_id) OVER w AS next FROM documents WINDOW w AS (PARTITION BY lang, source ORDER BY doc_id)""",
    "edition_stats": "SELECT role AS edition, count(*) AS n_rows, count(DISTINCT conv_id) AS n_texts FROM conversations GROUP BY 1",
}
