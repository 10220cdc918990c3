"""Surveys: exact occurrence of many terms over the whole corpus.

Terms are words, stems or phrases, in a list or a table of any size. Few words
and stems go to all tasks, where a row is matched by itself; more are matched
against the distinct vocabulary, which is small beside the corpus, and then
joined to it by equality. All phrases are looked for in one pass.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verseloom.functions.text import Kept, fold, folded_tokens, surface_tokens, tokens_of
from verseloom.operators.needles import needle_hits
from verseloom.operators.shared import BROADCAST_ROWS, checkpointed, join_counted


def term_table(spark: SparkSession, terms: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """Terms with their scope, "word" or "stem", each once; a list or ``terms(term, scope)``. One with a blank inside is a ``phrase``."""
    rows = terms.select("term", "scope").distinct() if isinstance(terms, DataFrame) else spark.createDataFrame(list(dict.fromkeys(terms)), "term string, scope string")
    return rows.withColumn("needle", fold(F.col("term"))).withColumn("phrase", F.contains("needle", F.lit(" ")))


def _stem_lengths(terms: DataFrame) -> list[int]:
    """Lengths of the stems; as few as there are lengths of words."""
    stems = terms.where("not phrase and scope = 'stem' and needle != ''")
    return sorted(r[0] for r in stems.select(F.length("needle")).distinct().collect())


def _keys(word: Column, lengths: list[int]) -> Column:
    """What the terms of a folded word are looked up by: the word, and its beginnings of the stems' lengths."""
    starts = [F.when(F.length(word) >= n, F.concat(F.lit("s"), F.substr(word, F.lit(1), F.lit(n)))) for n in lengths]
    return F.array(F.concat(F.lit("w"), word), *starts)


def _keyed(terms: DataFrame) -> DataFrame:
    """Words and stems with the key that ``_keys`` gives to what they match."""
    single = terms.where("not phrase and needle != ''")
    return single.select("term", "scope", F.concat(F.when(F.col("scope") == "stem", "s").otherwise("w"), "needle").alias("key"))


def _matched(vocabulary: DataFrame, folded: str, terms: DataFrame) -> DataFrame:
    """``term``, ``scope`` and the columns of a distinct vocabulary: its folded words equal to a word or starting with a stem, by an equality join."""
    keys = _keys(F.col(folded), _stem_lengths(terms))
    return vocabulary.withColumn("key", F.explode(keys)).join(_keyed(terms), "key").drop("key")


class _Matcher:
    """Numbers of the words and stems that a text holds."""

    def __init__(self, terms: list[tuple[str, str | None]]) -> None:
        self.words: dict[str, list[int]] = {}
        self.stems: dict[str, list[int]] = {}
        for k, (needle, scope) in enumerate(terms):
            (self.stems if scope == "stem" else self.words).setdefault(needle, []).append(k)
        self.starts = {s[:n] for s in self.stems for n in range(1, len(s) + 1)}
        self.known = Kept(self._of)

    def _of(self, token: str) -> tuple[int, ...]:
        found = list(self.words.get(token, ()))
        for n in range(1, len(token) + 1):
            start = token[:n]
            if start not in self.starts:
                break
            found += self.stems.get(start, ())
        return tuple(found)

    def __call__(self, text: str | None) -> set[int]:
        return set().union(*map(self.known.__getitem__, set(tokens_of(text))))


def _few_terms(terms: DataFrame, few: int) -> tuple[DataFrame, Broadcast] | None:
    """Words and stems as a table ``number``, ``term``, ``scope`` and as a broadcast list for ``_Matcher``; None if there are more than ``few``."""
    if terms.limit(few + 1).count() > few:
        return None
    rows = terms.where("not phrase and needle != ''").select("term", "scope", "needle").collect()
    spark = terms.sparkSession
    table = spark.createDataFrame([(k, r["term"], r["scope"]) for k, r in enumerate(rows)], "number int, term string, scope string")
    return table, spark.sparkContext.broadcast([(r["needle"], r["scope"]) for r in rows])


def _numbers(text: Column, known: Broadcast) -> Column:
    """Numbers of the terms that a text holds, each once."""

    @F.pandas_udf("array<int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        match = _Matcher(known.value)
        for texts in parts:
            yield pd.Series([list(match(t)) for t in texts], index=texts.index, dtype=object)

    return run(text)


def _runs(segments: DataFrame, known: Broadcast) -> DataFrame:
    """A row for each run of segments of a text that stand together: ``doc_id``, its first and last ``pos`` (``rising``: in order, none twice), and the ``n`` of its segments that hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = _Matcher(known.value)
        names = ["doc_id", "low", "high", "rising", "number", "n"]
        for batch in batches:
            out, counts = [], Counter()
            for doc, pos, text in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                if not out or out[-1][0] != doc:
                    counts = Counter()
                    out.append([doc, pos, pos, True, counts])
                else:
                    out[-1][3] &= pos > out[-1][2]
                    out[-1][2] = pos
                counts.update(match(text))
            columns = list(zip(*out)) if out else [()] * 5
            columns[4:] = [list(map(list, columns[4])), [list(c.values()) for c in columns[4]]]
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    kind = segments.schema["doc_id"].dataType.simpleString()
    rows = segments.select("doc_id", F.col("pos").cast("int").alias("pos"), "segment")
    return rows.mapInArrow(run, f"doc_id {kind}, low int, high int, rising boolean, number array<int>, n array<int>")


def _found_by_run(segments: DataFrame, known: Broadcast) -> DataFrame | None:
    """``number``, ``s`` segments and ``t`` texts of the terms; None if a segment comes twice.

    A text that is one run adds to both as it is; only those of several runs
    (cut by a batch, or in several places) are grouped by text.
    """
    runs = checkpointed(_runs(segments, known))
    several = checkpointed(runs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc_id").alias("__id")))
    of_several = F.col("doc_id").eqNullSafe(F.col("__id"))
    parts = runs.join(several, of_several, "left_semi")
    before = F.max("high").over(Window.partitionBy("doc_id").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1))
    if not runs.where("not rising").isEmpty() or not parts.withColumn("before", before).where("before >= low").isEmpty():
        return None
    each = lambda rows: rows.select("doc_id", F.explode(F.arrays_zip("number", "n")).alias("x")).select("doc_id", "x.number", "x.n")
    whole = each(runs.join(several, of_several, "left_anti")).groupBy("number").agg(F.sum("n").alias("s"), F.count("*").alias("t"))
    parted = each(parts).groupBy("doc_id", "number").agg(F.sum("n").alias("n")).groupBy("number").agg(F.sum("n").alias("s"), F.count("*").alias("t"))
    return whole.union(parted).groupBy("number").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))


def _phrase_hits(segments: DataFrame, terms: DataFrame) -> DataFrame:
    phrases = terms.where("phrase").select("term", "scope", "needle")
    more = needle_hits(segments, {"segment": fold(F.col("segment"))}, phrases).join(phrases, "needle")
    return more.select(*segments.columns, "term", "scope")


def term_hits(segments: DataFrame, terms: DataFrame, few: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each term and segment that holds it: whole folded words, words that start with a stem, or phrases as parts of the folded text.

    Up to ``few`` terms are sent to all executors, each segment is matched where it
    lies, and only if a segment comes twice do the hits go through a shuffle. More
    are matched with the distinct vocabulary first and joined to the segments by
    token, where the rows of a frequent token are split. Phrases of any number
    take one more pass.
    """
    keys = ["term", "scope", "doc_id", "pos"]
    listed = _few_terms(terms, few)
    if listed is not None:
        table, known = listed
        hits = segments.select("*", F.explode(_numbers(F.col("segment"), known)).alias("number")).join(F.broadcast(table), "number")
        hits = hits.select(*segments.columns, "term", "scope")
        if not segments.groupBy("doc_id", "pos").count().where("count > 1").isEmpty():
            hits = hits.dropDuplicates(keys)
    else:
        rows = segments.withColumn("token", F.explode(folded_tokens(F.col("segment"))))
        counted = checkpointed(rows.groupBy("token").agg(F.count("*").alias("n")))
        total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        hits = join_counted(rows, _matched(counted, "token", terms), "token", total, ["doc_id", "pos"], few)
        hits = hits.select(*segments.columns, "term", "scope").dropDuplicates(keys)
    return hits.union(_phrase_hits(segments, terms))


def _found(hits: DataFrame) -> DataFrame:
    per_text = hits.groupBy("term", "scope", "doc_id").count()
    return per_text.groupBy("term", "scope").agg(F.sum("count").alias("s"), F.count("*").alias("t"))


def survey_totals(segments: DataFrame, terms: DataFrame, few: int = BROADCAST_ROWS) -> DataFrame:
    """Segments and texts that hold each term; zeros for a term without a hit."""
    listed = _few_terms(terms, few)
    by_run = _found_by_run(segments, listed[1]) if listed is not None else None
    if by_run is None:
        found = _found(term_hits(segments, terms, few))
    else:
        found = by_run.join(F.broadcast(listed[0]), "number").select("term", "scope", "s", "t").union(_found(_phrase_hits(segments, terms)))
    return terms.select("term", "scope").join(found, ["term", "scope"], "left").select(
        "term",
        "scope",
        F.coalesce("s", F.lit(0)).cast("long").alias("total_segments"),
        F.coalesce("t", F.lit(0)).cast("long").alias("total_texts"),
    )


def survey_by_group(segments: DataFrame, terms: DataFrame) -> DataFrame:
    """Segments that hold each term, by level-1 key."""
    return term_hits(segments, terms).groupBy("term", "scope", "lang").agg(F.count("*").alias("n_segments"))


def survey_forms(segments: DataFrame, terms: DataFrame) -> DataFrame:
    """The distinct tokens, as written, behind each term's hits, with their number of segments; none for phrases."""
    forms = segments.select("doc_id", "pos", F.explode(F.array_distinct(surface_tokens(F.col("segment")))).alias("form"))
    vocabulary = forms.groupBy("form").agg(F.count("*").alias("n_segments")).withColumn("folded", fold(F.col("form")))
    return _matched(vocabulary, "folded", terms).select("term", "scope", "form", "n_segments")


def survey_page(hits: DataFrame, start: int, size: int) -> DataFrame:
    """Hits number ``start`` to ``start + size - 1`` of each term in document order, from 1, and where the next page starts (null: nowhere).

    One row more than the page shows whether there is a next one; Spark limits
    each term's rows before the shuffle.
    """
    w = Window.partitionBy("term", "scope").orderBy("doc_id", "pos")
    ranked = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= start + size)
    last = F.max("rank").over(Window.partitionBy("term", "scope"))
    ranked = ranked.withColumn("next_cursor", F.when(last == start + size, F.lit(start + size).cast("long")))
    return ranked.where(F.col("rank").between(start, start + size - 1)).select("term", "scope", "doc_id", "pos", "rank", "next_cursor")


def survey_corpus(segments: DataFrame, terms: DataFrame, start: int, size: int) -> DataFrame:
    """All parts of a survey, a row a term: totals, segments by level-1 key, the forms found, a page of hits and the next cursor."""
    hits = checkpointed(term_hits(segments, terms))
    keys = ["term", "scope"]
    per_text = hits.groupBy(*keys, "lang", "doc_id").count()
    per_lang = per_text.groupBy(*keys, "lang").agg(F.sum("count").alias("s"), F.count("*").alias("t"))
    totals = per_lang.groupBy(*keys).agg(
        F.sum("s").alias("s"), F.sum("t").alias("t"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce("lang", F.lit("")), "s")))).alias("by_group")
    )
    forms = survey_forms(segments, terms).groupBy(*keys).agg(F.sort_array(F.collect_set("form")).alias("forms"))
    page = survey_page(hits, start, size).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("rank", "doc_id", "pos"))).alias("page"), F.max("next_cursor").alias("next_cursor")
    )
    out = terms.select(*keys).join(totals, keys, "left").join(forms, keys, "left").join(page, keys, "left")
    return out.select(
        *keys,
        F.coalesce("s", F.lit(0)).cast("long").alias("total_segments"),
        F.coalesce("t", F.lit(0)).cast("long").alias("total_texts"),
        "by_group",
        "forms",
        "page",
        "next_cursor",
    )


def semantic_layer(near: DataFrame, texts: DataFrame, terms: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Vector hits of each query with the flag ``in_lexical``, and a summary of each query.

    ``near(query_id, id, distance)`` holds the hits within the threshold, the
    level filter applied before by the caller's choice of vectors;
    ``texts(id, text)``; ``terms(query_id, needle, scope)``. The summary tells
    ``returned``, ``new_finds`` (concept only) and ``capped`` (k or more hits).
    """
    rows = near.join(texts, "id").join(F.broadcast(terms), "query_id")
    words = F.transform(surface_tokens(F.col("text")), fold)
    same = F.exists(words, lambda w: F.when(F.col("scope") == "word", w == F.col("needle")).otherwise(F.startswith(w, F.col("needle"))))
    rows = rows.withColumn("in_lexical", F.coalesce(same, F.lit(False))).drop("text", "needle", "scope")
    summary = rows.groupBy("query_id").agg(
        F.count("*").alias("returned"), F.count_if(~F.col("in_lexical")).alias("new_finds"), (F.count("*") >= k).alias("capped")
    )
    return rows, summary


def concept_only(near: DataFrame, lexical: DataFrame) -> DataFrame:
    """Vector hits that the word search of the same query doesn't have."""
    return near.join(lexical.select("query_id", "id"), ["query_id", "id"], "left_anti")
