"""All queries over the test tables, by name, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from verseloom.functions.text import fold
from verseloom.operators import catalog, outline, passages, search, survey
from verseloom.plans.corpus_jobs import JOBS, JOBS_SQL
from verseloom.sources.corpus import editions, segments, table

TERMS = [("the", "word"), ("École", "word"), ("une", "word"), ("thon", "stem"), ("der", "word"), ("zzz", "word"), ("ge", "stem"), ("of the", "word")]
FALLBACK = ["nicht", "Étion", "zuver"]
STARTS = ["zuve", "the", "einac", "ereringr"]
FUZZY = ["which", "nicht", "erlich"]
ASKED = {"the from": 0, "und nicht": 7, "la que": 42}  # words, and the id of a vector


def _docs(spark, d):
    return table(spark, d, "documents")


def _survey(operator):
    return lambda spark, d: operator(segments(_docs(spark, d)), survey.term_table(spark, TERMS))


def _flat_survey(rows):
    """Maps and arrays as strings."""
    groups = F.array_join(F.transform(F.sort_array(F.map_entries("by_group")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    page = F.array_join(F.transform("page", lambda p: F.concat_ws(":", p["doc_id"].cast("string"), p["pos"].cast("string"))), ",")
    return rows.select(
        "term", "scope", "total_segments", "total_texts", F.coalesce(groups, F.lit("")).alias("by_group"), F.coalesce(F.size("forms"), F.lit(0)).cast("long").alias("n_forms"),
        F.coalesce(page, F.lit("")).alias("page"), "next_cursor",
    )


QUERIES = {
    "survey_totals": _survey(survey.survey_totals),
    "survey_by_group": _survey(survey.survey_by_group),
    "survey_forms": _survey(survey.survey_forms),
    "structure_counts": lambda s, d: catalog.structure_counts(_docs(s, d), segments(_docs(s, d))),
    "text_sizes": lambda s, d: catalog.text_sizes(_docs(s, d), segments(_docs(s, d))),
    "compare_editions": lambda s, d: catalog.compare_editions(editions(table(s, d, "conversations"))),
    "embedding_progress": lambda s, d: catalog.embedding_progress(_docs(s, d), table(s, d, "embeddings")),
    "missing_embeddings": lambda s, d: catalog.missing_embeddings(_docs(s, d), table(s, d, "embeddings")),
    "markup_census": lambda s, d: catalog.markup_census(table(s, d, "pages")),
    "dedup_by_key": lambda s, d: catalog.dedup_by_key(segments(_docs(s, d)), fold("segment")),
    "survey_corpus": lambda s, d: _flat_survey(survey.survey_corpus(segments(_docs(s, d)), survey.term_table(s, TERMS), 1, 20)),
    "posting_sizes": lambda s, d: search.posting_sizes(_docs(s, d)),
    "vocabulary": lambda s, d: search.vocabulary(_docs(s, d)),
    "prefix_suggestions": lambda s, d: search.prefix_suggestions(search.vocabulary(_docs(s, d)), STARTS),
    "related_words": lambda s, d: search.related_words(search.vocabulary(_docs(s, d)), STARTS),
    "fuzzy_words": lambda s, d: search.fuzzy_words(search.vocabulary(_docs(s, d)), FUZZY),
    "bm25_search": lambda s, d: search.bm25_search(_docs(s, d), list(ASKED)),
    "semantic_topk": lambda s, d: search.semantic_topk(table(s, d, "embeddings"), list(ASKED.values())),
    "hybrid_search": lambda s, d: search.hybrid_search(_docs(s, d), table(s, d, "embeddings"), ASKED),
    "context_block": lambda s, d: passages.context_block(segments(_docs(s, d)), "und"),
    "text_page": lambda s, d: passages.text_page(segments(_docs(s, d)), 5, 10),
    "outline_by_key": lambda s, d: passages.outline_by_key(table(s, d, "conversations")),
    "pick_edition": lambda s, d: passages.pick_edition(editions(table(s, d, "conversations")), ["system", "assistant", "user"]),
    "paired_passages": lambda s, d: passages.paired_passages(segments(_docs(s, d)), "from", "with"),
    "one_per_text": lambda s, d: passages.one_per_text(segments(_docs(s, d)), "7", 20),
    "cap_per_text": lambda s, d: passages.cap_per_text(_survey(survey.term_hits)(s, d), 2),
    "survey_page": lambda s, d: survey.survey_page(_survey(survey.term_hits)(s, d), 11, 20),
    "snapshot_diff": lambda s, d: passages.snapshot_diff(
        *[_survey(survey.term_hits)(s, d).where(f"term = '{t}'").select("doc_id", "pos") for t in ("der", "the")]
    ),
    "sections_listing": lambda s, d: passages.sections_listing(_docs(s, d)),
    "embedding_input": lambda s, d: _docs(s, d).select(
        "doc_id", F.md5(passages.embedding_input(F.col("text"), F.col("lang"), F.col("source"))).alias("input")
    ),
    "coverage": lambda s, d: passages.coverage(_docs(s, d), search.vocabulary(table(s, d, "benchmark").withColumnRenamed("item_id", "doc_id"))),
    "corpus_checks": lambda s, d: passages.corpus_checks(_docs(s, d), table(s, d, "embeddings")),
    "natural_key": lambda s, d: table(s, d, "pages").select("page_id", outline.natural_key(F.col("url")).alias("key")),
    "outline_by_header": lambda s, d: outline.outline_by_header(segments(_docs(s, d)), ~F.contains("segment", F.lit("."))),
    "whole_word_or_substring": lambda s, d: outline.whole_word_or_substring(segments(_docs(s, d)), FALLBACK),
    "reserve_slots": lambda s, d: outline.reserve_slots(
        _survey(survey.term_hits)(s, d)
        .groupBy("term", "scope", "doc_id", "lang")
        .agg(F.count("*").alias("score"))
        .select("term", "doc_id", "score", F.coalesce(F.col("lang") != "en", F.lit(True)).alias("secondary")),
        10,
    ),
    "neighbour_arrays": lambda s, d: outline.neighbour_arrays(segments(_docs(s, d))).select(
        "doc_id", "pos", F.md5(F.array_join("block.segment", "|")).alias("block"), F.array_join("block.pos", ",").alias("places")
    ),
    "export_conversations": lambda s, d: outline.export_conversations(table(s, d, "conversations")),
}

_TERMS = ", ".join(f"('{t}', '{s}')" for t, s in TERMS)
_SEGMENTS = """seg AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS segment,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"""
_HITS = f"""WITH terms AS (SELECT term, scope, lower(strip_accents(term)) AS needle FROM (VALUES {_TERMS}) AS x(term, scope)),
{_SEGMENTS}, tok AS (SELECT DISTINCT doc_id, lang, pos, t FROM (
  SELECT doc_id, lang, pos, unnest(regexp_extract_all(lower(strip_accents(segment)), '[a-z0-9]+')) AS t FROM seg)),
hits AS (SELECT DISTINCT term, scope, doc_id, lang, pos FROM tok JOIN terms
  ON CASE WHEN scope = 'word' THEN t = needle ELSE starts_with(t, needle) END
  UNION ALL SELECT term, scope, doc_id, lang, pos FROM seg JOIN terms ON contains(needle, ' ') AND contains(lower(strip_accents(segment)), needle)),
forms AS (SELECT DISTINCT doc_id, pos, f FROM (SELECT doc_id, pos, unnest(regexp_extract_all(segment, '[\\p{{L}}\\p{{N}}_]+')) AS f FROM seg)),
found AS (SELECT term, scope, f AS form, count(*) AS n_segments FROM forms JOIN terms
  ON CASE WHEN scope = 'word' THEN lower(strip_accents(f)) = needle ELSE starts_with(lower(strip_accents(f)), needle) END GROUP BY 1, 2, 3)"""
_EDITIONS = "ed AS (SELECT conv_id, turn // 2 AS seg, role AS edition FROM conversations)"

_TOKENS = """tok AS (SELECT doc_id, i - 1 AS pos, ts[i] AS token, len(ts) AS dl FROM (
  SELECT doc_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[a-z0-9]+') AS ts FROM documents)))"""
_VOCABULARY = _TOKENS + """, voc AS (SELECT token, count(DISTINCT doc_id) AS n_texts, count(*) AS n_total FROM tok GROUP BY 1)"""
_FALLBACK = ", ".join(f"('{x}')" for x in FALLBACK)
_STARTS = ", ".join(f"('{x}')" for x in STARTS)
_GRAMS = "list_distinct(list_transform(range(1, length({0}) + 2), lambda i: substr('  ' || {0} || ' ', i, 3)))"
_ASKED = ", ".join(f"('{q}', '{w}', {len(q.split())})" for q in ASKED for w in q.split())
_BM25 = f"""{_TOKENS}, asked AS (SELECT * FROM (VALUES {_ASKED}) AS x(query, token, need)),
n AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM tok) / (SELECT count(*) FROM documents) AS mean),
tf AS (SELECT doc_id, token, count(*) AS tf, any_value(dl) AS dl FROM tok GROUP BY 1, 2),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT query, doc_id, round(sum(greatest(ln((n.n - df + 0.5) / (df + 0.5)), {search.LEAST_IDF}) * tf * {search.K1 + 1}
  / (tf + {search.K1} * (1 - {search.B} + {search.B} * dl / n.mean))), 4) AS score
  FROM tf JOIN df USING (token) JOIN asked USING (token), n GROUP BY 1, 2 HAVING count(*) = any_value(need)),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM bm)"""
_NEAR = f"""vec AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
near AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_distance(q.e, v.e), 4) AS distance
  FROM vec q, vec v WHERE q.vec_id IN ({", ".join(map(str, ASKED.values()))})),
nearr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM near WHERE distance <= 1)"""
_NAMES = ", ".join(f"('{q}', {i})" for q, i in ASKED.items())

ORACLE_SQL = {
    "survey_totals": f"""{_HITS} SELECT t.term, t.scope, count(h.pos) AS total_segments, count(DISTINCT h.doc_id) AS total_texts
        FROM terms t LEFT JOIN hits h ON t.term = h.term AND t.scope = h.scope GROUP BY 1, 2""",
    "survey_by_group": f"{_HITS} SELECT term, scope, lang, count(*) AS n_segments FROM hits GROUP BY 1, 2, 3",
    "survey_forms": f"{_HITS} SELECT * FROM found",
    "structure_counts": f"""WITH {_SEGMENTS} SELECT lang, source, count(DISTINCT doc_id) AS n_texts, count(*) AS n_segments
        FROM seg GROUP BY 1, 2""",
    "text_sizes": f"""WITH {_SEGMENTS} SELECT d.doc_id, count(s.pos) AS n_segments FROM documents d
        LEFT JOIN seg s ON s.doc_id = d.doc_id AND trim(s.segment) <> '' GROUP BY 1""",
    "compare_editions": f"""WITH {_EDITIONS} SELECT conv_id, seg, string_agg(edition, ',' ORDER BY edition) AS editions,
        count(*) AS n_editions FROM ed GROUP BY 1, 2""",
    "embedding_progress": """SELECT lang, count(*) AS total, count(*) FILTER (v.vec_id IS NULL) AS missing, count(v.vec_id) AS done, round(100.0 * count(v.vec_id) / count(*), 2)::DOUBLE AS percent
        FROM documents d LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings WHERE embedding IS NOT NULL) v
        ON v.vec_id = d.doc_id GROUP BY ROLLUP (lang)""",
    "missing_embeddings": """SELECT doc_id FROM documents WHERE doc_id NOT IN (
        SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL)""",
    "markup_census": """SELECT lower(tag) AS tag, count(*) AS n FROM (
        SELECT unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages) GROUP BY 1""",
    "dedup_by_key": f"""WITH {_SEGMENTS} SELECT doc_id, pos::INT AS pos, n - 1 AS duplicates FROM (
        SELECT doc_id, pos, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS r
        FROM (SELECT doc_id, pos, lower(strip_accents(segment)) AS k FROM seg)) WHERE r = 1""",
    "posting_sizes": f"""WITH {_TOKENS} SELECT doc_id, token, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos
        FROM tok GROUP BY 1, 2""",
    "vocabulary": f"WITH {_VOCABULARY} SELECT * FROM voc",
    "prefix_suggestions": f"""WITH {_VOCABULARY}, s AS (SELECT start FROM (VALUES {_STARTS}) AS x(start) WHERE start NOT IN (SELECT token FROM voc))
        SELECT start, token, row_number() OVER (PARTITION BY start ORDER BY length(token), token) AS rank
        FROM voc JOIN s ON starts_with(token, start) QUALIFY rank <= 3""",
    "related_words": f"""WITH {_VOCABULARY}, s AS (SELECT part FROM (VALUES {_STARTS}) AS x(part))
        SELECT part, token, row_number() OVER (PARTITION BY part ORDER BY length(token), token) AS rank
        FROM voc JOIN s ON contains(token, part) AND token <> part QUALIFY rank <= 10""",
    "fuzzy_words": f"""WITH {_VOCABULARY}, t AS (SELECT term, {_GRAMS.format("term")} AS h FROM (VALUES {", ".join(f"('{x}')" for x in FUZZY)}) AS x(term)),
        v AS (SELECT token, {_GRAMS.format("token")} AS g FROM voc),
        s AS (SELECT term, token, len(list_intersect(g, h)) AS b, len(g) + len(h) AS ab FROM v, t),
        r AS (SELECT term, token, round(b / (ab - b), 4) AS similarity FROM s WHERE b > 0)
        SELECT *, row_number() OVER (PARTITION BY term ORDER BY similarity DESC, token) AS rank FROM r
        WHERE similarity >= 0.3 QUALIFY rank <= 10""",
    "bm25_search": f"WITH {_BM25} SELECT query, doc_id, score, rank FROM bmr WHERE rank <= 10",
    "semantic_topk": f"WITH {_NEAR} SELECT query_id, vec_id, distance, rank FROM nearr WHERE rank <= 10",
    "hybrid_search": f"""WITH {_BM25}, {_NEAR}, legs AS (SELECT query, doc_id AS id, 1 / (60 + rank) AS p FROM bmr WHERE rank <= 50
        UNION ALL SELECT query, vec_id, 1 / (60 + rank) FROM nearr JOIN (VALUES {_NAMES}) AS x(query, query_id) USING (query_id) WHERE rank <= 50),
        f AS (SELECT query, id, round(sum(p), 4) AS score FROM legs GROUP BY 1, 2)
        SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 10""",
    "context_block": f"""WITH {_SEGMENTS}, a AS (SELECT doc_id, pos, list_contains(regexp_extract_all(lower(strip_accents(segment)), '[a-z0-9]+'), 'und') AS is_anchor FROM seg)
        SELECT doc_id, pos::INT AS pos, is_anchor FROM a WHERE EXISTS (
          SELECT 1 FROM a b WHERE b.doc_id = a.doc_id AND b.is_anchor AND a.pos BETWEEN b.pos - 2 AND b.pos + 2)""",
    "text_page": f"""WITH {_SEGMENTS}, n AS (SELECT doc_id, count(*) AS total FROM seg GROUP BY 1)
        SELECT doc_id, pos::INT AS pos, total, CASE WHEN total > 15 THEN 15::BIGINT END AS next_offset FROM seg JOIN n USING (doc_id) WHERE pos BETWEEN 5 AND 14""",
    "outline_by_key": """WITH c AS (SELECT conv_id, turn, role, (role IS DISTINCT FROM lag(role) OVER w OR lag(turn) OVER w IS NULL)::INT AS c
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)),
        r AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn, role)::BIGINT AS section FROM c)
        SELECT conv_id, section, min(role) AS role, min(turn) AS "first", max(turn) AS "last", count(*) AS n FROM r GROUP BY 1, 2""",
    "pick_edition": """SELECT edition, count(*) AS n_texts FROM (SELECT conv_id, CASE WHEN bool_or(role = 'system') THEN 'system'
        WHEN bool_or(role = 'assistant') THEN 'assistant' ELSE 'user' END AS edition FROM conversations GROUP BY 1) GROUP BY 1""",
    "paired_passages": f"""WITH {_SEGMENTS}, a AS (SELECT doc_id, pos, regexp_extract_all(lower(strip_accents(segment)), '[a-z0-9]+') AS t FROM seg)
        SELECT doc_id, count(*) FILTER (list_contains(t, 'from')) AS n_open, count(*) FILTER (list_contains(t, 'with')) AS n_close,
        (min(pos) FILTER (list_contains(t, 'from')))::INT AS first_open FROM a GROUP BY 1 HAVING n_open > 0 AND n_close > 0""",
    "one_per_text": f"""WITH {_SEGMENTS}, h AS (SELECT doc_id, pos, md5('7|' || doc_id || '|' || pos) AS h FROM seg),
        b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY h, pos) = 1)
        SELECT doc_id, pos::INT AS pos FROM b ORDER BY h, doc_id LIMIT 20""",
    "cap_per_text": f"""{_HITS} SELECT term, scope, doc_id, pos::INT AS pos FROM hits
        QUALIFY row_number() OVER (PARTITION BY term, scope, doc_id ORDER BY pos) <= 2""",
    "survey_page": f"""{_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY term, scope ORDER BY doc_id, pos) AS rank, count(*) OVER (PARTITION BY term, scope) AS n FROM hits)
        SELECT term, scope, doc_id, pos::INT AS pos, rank, CASE WHEN n > 30 THEN 31::BIGINT END AS next_cursor FROM r WHERE rank BETWEEN 11 AND 30""",
    "survey_corpus": f"""{_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY term, scope ORDER BY doc_id, pos) AS rank FROM hits),
        g AS (SELECT term, scope, string_agg(coalesce(lang, '') || '=' || n, ',' ORDER BY coalesce(lang, '')) AS by_group FROM (SELECT term, scope, lang, count(*) AS n FROM hits GROUP BY 1, 2, 3) GROUP BY 1, 2),
        a AS (SELECT term, scope, count(*) AS s, count(DISTINCT doc_id) AS t, string_agg(doc_id || ':' || pos, ',' ORDER BY rank) FILTER (rank <= 20) AS page FROM r GROUP BY 1, 2)
        SELECT t.term, t.scope, coalesce(a.s, 0) AS total_segments, coalesce(a.t, 0) AS total_texts, coalesce(by_group, '') AS by_group,
        (SELECT count(*) FROM found f WHERE f.term = t.term AND f.scope = t.scope) AS n_forms, coalesce(page, '') AS page, CASE WHEN a.s > 20 THEN 21::BIGINT END AS next_cursor
        FROM terms t LEFT JOIN a ON a.term = t.term AND a.scope = t.scope LEFT JOIN g ON g.term = t.term AND g.scope = t.scope""",
    "snapshot_diff": f"""{_HITS}, a AS (SELECT doc_id, pos::INT AS pos FROM hits WHERE term = 'der'), b AS (SELECT doc_id, pos::INT AS pos FROM hits WHERE term = 'the')
        SELECT *, 'lost' AS change FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
        UNION ALL SELECT *, 'gained' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
    "sections_listing": """SELECT lang, string_agg(source, ',' ORDER BY source) AS sources, sum(n)::BIGINT AS n_texts
        FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1""",
    "embedding_input": """SELECT doc_id, md5(concat_ws(' | ', CASE WHEN trim(text) <> '' THEN text END, CASE WHEN trim(lang) <> '' THEN lang END,
        CASE WHEN trim(source) <> '' THEN source END)) AS input FROM documents""",
    "coverage": f"""WITH {_TOKENS}, known AS (SELECT DISTINCT unnest(regexp_extract_all(lower(strip_accents(text)), '[a-z0-9]+')) AS token FROM benchmark)
        SELECT doc_id, count(*) AS n_tokens, count(k.token) AS n_known FROM tok LEFT JOIN known k USING (token) GROUP BY 1""",
    "corpus_checks": """SELECT 'null id' AS rule, count(*) FILTER (doc_id IS NULL) AS n FROM documents
        UNION ALL SELECT 'null text', count(*) FILTER (text IS NULL) FROM documents
        UNION ALL SELECT 'blank text', count(*) FILTER (trim(text) = '') FROM documents
        UNION ALL SELECT 'wrong length', count(*) FILTER (length(text) <> n_chars) FROM documents
        UNION ALL SELECT 'repeated id', count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)
        UNION ALL SELECT 'vector without text', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)""",
    "natural_key": """SELECT page_id, array_to_string(list_transform(regexp_extract_all(coalesce(url, ''), '[0-9]+|[^0-9]+'), lambda x:
        CASE WHEN NOT regexp_matches(x, '^[0-9]') THEN x WHEN length(ltrim(x, '0')) < 20 THEN lpad(ltrim(x, '0'), 20, '0')
        ELSE ltrim(x, '0') END), '') AS key FROM pages""",
    "outline_by_header": f"""WITH {_SEGMENTS}, h AS (SELECT doc_id, pos, NOT contains(segment, '.') AS h FROM seg),
        s AS (SELECT *, greatest(sum(h::INT) OVER (PARTITION BY doc_id ORDER BY pos), 1)::BIGINT AS section FROM h)
        SELECT doc_id, section, (min(pos) FILTER (h))::INT AS header, min(pos)::INT AS "first", max(pos)::INT AS "last", count(*) AS n FROM s GROUP BY 1, 2""",
    "whole_word_or_substring": f"""WITH {_SEGMENTS}, a AS (SELECT term, lower(strip_accents(term)) AS needle FROM (VALUES {_FALLBACK}) AS x(term)),
        f AS (SELECT doc_id, pos, lower(strip_accents(segment)) AS f FROM seg),
        m AS (SELECT term, doc_id, pos, list_contains(regexp_extract_all(f, '[a-z0-9]+'), needle) AS whole FROM f JOIN a ON contains(f, needle))
        SELECT term, doc_id, pos::INT AS pos, whole FROM m QUALIFY whole = bool_or(whole) OVER (PARTITION BY term)""",
    "reserve_slots": f"""{_HITS}, r AS (SELECT term, doc_id, count(*) AS score, coalesce(lang <> 'en', true) AS secondary FROM hits GROUP BY term, scope, doc_id, lang),
        o AS (SELECT *, row_number() OVER (PARTITION BY term, secondary ORDER BY score DESC, doc_id) AS own FROM r),
        k AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY term ORDER BY (secondary AND own <= 2) DESC, score DESC, doc_id) <= 10)
        SELECT term, doc_id, score, secondary, row_number() OVER (PARTITION BY term ORDER BY score DESC, doc_id)::INT AS rank FROM k""",
    "neighbour_arrays": f"""WITH {_SEGMENTS} SELECT doc_id, pos::INT AS pos, md5(string_agg(segment, '|') OVER w) AS block,
        string_agg(pos::VARCHAR, ',') OVER w AS places FROM seg WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""",
    "export_conversations": """SELECT conv_id, count(*) AS n_turns, to_json({'conv_id': conv_id, 'turns':
        list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text)})::VARCHAR AS value FROM conversations GROUP BY conv_id""",
}

QUERIES |= JOBS
ORACLE_SQL |= JOBS_SQL
