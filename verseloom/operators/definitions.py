"""Definition mining: the segments that define each of a list of terms, classified, scored, ranked and shown in context.

Segments come as ``text_id``, ``segment_id``, ``pos``, ``text``. Terms are a list or
a table of any size: the forms of few are sent to all tasks, where a segment is
matched by itself, those of many joined by equality. All markers, endings and weights are a ``DefinitionRules``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verseloom.functions.ids import id_prefix, in_sources, paragraph_key, stratum
from verseloom.functions.text import Kept, fold, folded_tokens, tokens_of
from verseloom.operators.shared import checkpointed, join_counted, request_table
from verseloom.rules.canon import DefinitionRules

FEW_TERMS = 5_000  # terms, of some twenty forms each, that are sent to all executors


def _endings(term: Column, of_stem: tuple[str, ...], of_other: tuple[str, ...]) -> Column:
    in_a = F.endswith(term, F.lit("a")) & (F.length(term) > 2)
    stem = F.substr(term, F.lit(1), F.length(term) - 1)
    made = lambda base, ends: F.array(*[F.concat(base, F.lit(e)) for e in ends])
    return F.when(in_a, made(stem, of_stem)).otherwise(made(term, of_other))


def inflected_forms(term: Column, rules: DefinitionRules) -> Column:
    """All forms of a folded term, itself included."""
    return F.array_distinct(F.array_union(F.array(term), _endings(term, rules.stem_endings, rules.other_endings)))


def oblique_forms(term: Column, rules: DefinitionRules) -> Column:
    """Forms in which a term is a place, a means or a source, not what is defined."""
    return _endings(term, rules.oblique_stem, rules.oblique_other)


def genitive_forms(term: Column, rules: DefinitionRules) -> Column:
    """Forms that count only beside a word of designation."""
    return _endings(term, rules.genitive_stem, rules.genitive_other)


def term_table(spark: SparkSession, terms: list[str] | DataFrame, rules: DefinitionRules) -> DataFrame:
    """``term`` with its ``forms``, ``oblique`` and ``genitive``; terms that fold to nothing go."""
    rows = request_table(spark, terms, "term").withColumn("needle", fold(F.col("term"))).where("needle != ''")
    n = F.col("needle")
    return rows.select("term", inflected_forms(n, rules).alias("forms"), oblique_forms(n, rules).alias("oblique"), genitive_forms(n, rules).alias("genitive"))


def _joined(rows: DataFrame, terms: DataFrame, spread: list[str] | None = None) -> DataFrame:
    """``rows`` with what belongs to their ``term``, or, with ``spread``, to each form of a term that they hold: broadcast where terms are few."""
    few = terms.limit(FEW_TERMS + 1).count() <= FEW_TERMS
    if spread is None:
        return rows.join(F.broadcast(terms) if few else terms, "term")
    forms = terms.select("term", F.explode("forms").alias("form"))
    if few:
        return rows.join(F.broadcast(forms), "form")
    counted = checkpointed(rows.groupBy("form").agg(F.count("*").alias("n")))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return join_counted(rows, forms.join(counted, "form"), "form", total, spread, 0)


def _starts(token: Column, beginnings: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for b in beginnings:
        found = found | F.startswith(token, F.lit(b))
    return found


ASK, PAIR, SAY, LIKE, NAMED, QUESTION, DESIGNATION, POINTING, CLOSING, NUMERAL = (1 << k for k in range(10))


def token_marks(tokens: Column, rules: DefinitionRules) -> Column:
    """The tokens that mean something to the rules: (place, bits), in order; few of a text."""

    def bits(t: Column) -> Column:
        true = ~t.isin(list(rules.false_markers))
        tests = {
            ASK: _starts(t, rules.interrogative) & true,
            PAIR: F.startswith(t, F.lit(rules.question_pair)),
            SAY: _starts(t, rules.predicate) & true,
            LIKE: _starts(t, rules.simile) & true,
            NAMED: t == rules.named,
            QUESTION: t == rules.question_word,
            DESIGNATION: F.startswith(t, F.lit(rules.designation)),
            POINTING: t.isin(list(rules.demonstratives)),
            CLOSING: F.startswith(t, F.lit(rules.closing)),
            NUMERAL: t.isin(list(rules.numerals)),
        }
        total = F.lit(0)
        for bit, test in tests.items():
            total = total + F.when(test, bit).otherwise(0)
        return total

    marked = F.transform(tokens, lambda t, i: F.struct(i.alias("i"), bits(t).alias("b")))
    return F.filter(marked, lambda m: m["b"] > 0)


def marks_of(token: str, rules: DefinitionRules) -> int:
    """The bits of ``token_marks`` for one token, for use inside a task."""
    true = token not in rules.false_markers
    tests = {
        ASK: token.startswith(rules.interrogative) and true,
        PAIR: token.startswith(rules.question_pair),
        SAY: token.startswith(rules.predicate) and true,
        LIKE: token.startswith(rules.simile) and true,
        NAMED: token == rules.named,
        QUESTION: token == rules.question_word,
        DESIGNATION: token.startswith(rules.designation),
        POINTING: token in rules.demonstratives,
        CLOSING: token.startswith(rules.closing),
        NUMERAL: token in rules.numerals,
    }
    return sum(bit for bit, test in tests.items() if test)


def _few_forms(terms: DataFrame) -> dict[str, list[str]] | None:
    """The terms of each form, if the terms are few."""
    if terms.limit(FEW_TERMS + 1).count() > FEW_TERMS:
        return None
    found: dict[str, list[str]] = {}
    for r in terms.select("term", F.explode("forms").alias("form")).distinct().collect():
        found.setdefault(r["form"], []).append(r["term"])
    return found


def _in_place(text: Column, forms: dict[str, list[str]], rules: DefinitionRules) -> Column:
    """For each term that a text with a marker holds, its places, the forms present and the text's marks."""
    kind = "array<struct<term string, places array<int>, present array<string>, marks array<struct<i int, b int>>>>"

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bits = Kept(lambda token: marks_of(token, rules))
        for texts in parts:
            yield pd.Series([one(t, bits) for t in texts], index=texts.index, dtype=object)

    def one(text: str | None, bits: Kept) -> list[dict]:
        tokens = tokens_of(text)
        if forms.keys().isdisjoint(tokens):
            return []
        marks = [(i, b) for i, b in enumerate(map(bits.__getitem__, tokens)) if b]
        if not any(b & (ASK | PAIR | SAY | LIKE | NAMED) for _, b in marks):
            return []
        held: dict[str, dict[str, list[int]]] = {}
        for i, token in enumerate(tokens):
            for term in forms.get(token, ()):
                held.setdefault(term, {}).setdefault(token, []).append(i)
        listed = [{"i": i, "b": b} for i, b in marks]
        return [{"term": t, "places": sorted(sum(f.values(), [])), "present": list(f), "marks": listed} for t, f in held.items()]

    return run(text)


def _terms_in(text: Column, forms: dict[str, list[str]]) -> Column:
    """The terms of which a text holds a form, each once."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([list({x for t in forms.keys() & set(tokens_of(v)) for x in forms[t]}) for v in texts], index=texts.index, dtype=object)

    return run(text)


def _of(marks: Column | str, bits: int) -> Column:
    return F.filter(marks, lambda m: m["b"].bitwiseAND(F.lit(bits)) > 0)


def min_token_distance(places: Column | str, marks: Column | str, bits: int) -> Column:
    """The smallest distance of a place of the term and a mark of some kinds; null without both."""
    return F.array_min(F.transform(places, lambda a: F.array_min(F.transform(_of(marks, bits), lambda m: F.abs(a - m["i"])))))


def is_closer(places: Column | str, marks: Column | str, rules: DefinitionRules) -> Column:
    """A demonstrative, right behind it the closing word, and the term within the next words."""
    return F.exists(
        _of(marks, POINTING),
        lambda m: F.exists(_of(marks, CLOSING), lambda c: c["i"] == m["i"] + 1)
        & F.exists(places, lambda p: (p > m["i"] + 1) & (p <= m["i"] + 1 + rules.closer_window)),
    )


def candidates(segments: DataFrame, terms: DataFrame, rules: DefinitionRules) -> DataFrame:
    """Segments that hold a form of a term and a marker, once for each term, with the term's ``places``, the forms ``present`` and the ``marks``.

    Few terms are looked for with the marks in each row by itself. For many, marks
    are looked for once for all terms; only rows with a marker are exploded. A row's
    tokens don't go through the shuffle; the rows of a form that very many hold are
    split.
    """
    forms = _few_forms(terms)
    if forms is not None:
        found = segments.select("text_id", "segment_id", "pos", "text", F.explode(_in_place(F.col("text"), forms, rules)).alias("x"))
        return _joined(found.select("x.term", "text_id", "segment_id", "pos", "x.places", "x.present", "x.marks", "text"), terms)
    tokens = folded_tokens(F.col("text"))
    rows = segments.select("text_id", "segment_id", "pos", "text", tokens.alias("tokens"), token_marks(tokens, rules).alias("marks"))
    rows = rows.where(F.size(_of("marks", ASK | PAIR | SAY | LIKE | NAMED)) > 0)
    each = rows.select("text_id", "segment_id", "pos", "text", "marks", F.posexplode("tokens").alias("at", "form"))
    hits = _joined(each, terms, ["text_id", "segment_id", "pos"])
    found = hits.groupBy("term", "text_id", "segment_id", "pos").agg(
        F.sort_array(F.collect_set("at")).alias("places"), F.collect_set("form").alias("present"), F.first("marks").alias("marks"), F.first("text").alias("text")
    )
    return _joined(found, terms)


def classify(rows: DataFrame, rules: DefinitionRules) -> DataFrame:
    """Of ``candidates`` those that define their term, with ``markers``, ``kind``, ``detail``, ``closer`` and ``distance``.

    Rejected in this order: oblique forms alone; genitive or oblique ones alone
    without a word of designation; no marker near enough.
    """
    has = lambda bit: F.size(_of("marks", bit)) > 0
    rows = rows.where(F.size(F.array_except("present", "oblique")) > 0)
    rows = rows.where((F.size(F.array_except("present", F.array_union("genitive", "oblique"))) > 0) | has(DESIGNATION))

    def near(bits: int) -> Column:
        d = min_token_distance("places", "marks", bits)
        return F.when(d <= rules.proximity, d)

    rows = rows.withColumns(
        {
            "ask": F.when(has(QUESTION) & has(PAIR), near(ASK | PAIR)).otherwise(near(ASK)),
            "say": near(SAY),
            "like": near(LIKE),
            "beside": F.exists(_of("marks", NAMED), lambda m: F.array_contains("places", m["i"] - 1)),
            "closer": is_closer("places", "marks", rules),
        }
    )
    marks = F.array_compact(
        F.array(
            F.when(F.col("ask").isNotNull(), "interrogative"),
            F.when(F.col("say").isNotNull(), "predicate"),
            F.when(F.col("beside"), "named"),
            F.when(F.col("like").isNotNull(), "simile"),
        )
    )
    rows = rows.withColumn("markers", marks).where(F.size("markers") > 0)
    return rows.select(
        "term",
        "text_id",
        "segment_id",
        "pos",
        "text",
        "markers",
        F.when(F.size(F.array_except("markers", F.array(F.lit("simile")))) > 0, "direct").otherwise("simile").alias("kind"),
        F.when(has(NUMERAL), "enumerative").otherwise("descriptive").alias("detail"),
        "closer",
        F.array_min(F.array_compact(F.array("ask", "say", "like", F.when(F.col("beside"), 1)))).alias("distance"),
    )


def _stratum(rules: DefinitionRules) -> Column:
    return stratum(F.col("text_id"), dict(rules.strata), rules.family, rules.family_stratum, rules.other_stratum)


def score(rows: DataFrame, rules: DefinitionRules) -> DataFrame:
    """Classified rows with their ``stratum`` and ``score``."""
    has = lambda m: F.array_contains("markers", m)
    part = lambda test, n: F.when(test, n).otherwise(0)
    rows = rows.withColumn("stratum", _stratum(rules))
    penalty = F.element_at(F.array(*map(F.lit, rules.penalties)), F.col("stratum") + 1)
    total = (
        part(has("predicate"), 100)
        + part(has("interrogative"), 90)
        + part(has("named"), 85)
        + part(F.col("kind") == "simile", 40)
        + F.when(F.col("detail") == "descriptive", 25).otherwise(-5)
        + part(id_prefix(F.col("segment_id")).isin(list(rules.listed)), 15)
        + F.greatest(F.lit(0), F.lit(rules.proximity) - F.col("distance"))
        + part(F.col("closer"), rules.closer_bonus)
        + penalty
    )
    return rows.withColumn("score", total.cast("int"))


def paired_paragraphs(segments: DataFrame, opening: str, answer: str) -> DataFrame:
    """Opening rows of the paragraphs that hold a word starting like ``opening`` and one starting like ``answer``; one group-by."""

    @F.pandas_udf("array<struct<o boolean, c boolean>>")
    def begins(texts: pd.Series) -> pd.Series:
        found = [(any(t.startswith(opening) for t in ts), any(t.startswith(answer) for t in ts)) for ts in map(tokens_of, texts)]
        return pd.Series([[{"o": o, "c": c}] if o or c else [] for o, c in found], index=texts.index, dtype=object)

    rows = segments.select("text_id", "segment_id", "pos", "text", F.explode(begins("text")).alias("x"))
    rows = rows.select("text_id", "segment_id", "pos", "text", paragraph_key(F.col("segment_id")).alias("paragraph"), "x.o", "x.c")
    found = rows.groupBy("text_id", "paragraph").agg(
        F.max("c").alias("closed"), F.collect_list(F.when(F.col("o"), F.struct("segment_id", "pos", "text"))).alias("openers")
    )
    openers = found.where("closed").select("text_id", "paragraph", F.explode("openers").alias("r"))
    return openers.select("text_id", "paragraph", F.col("r.segment_id").alias("segment_id"), F.col("r.pos").alias("pos"), F.col("r.text").alias("text"))


def context_examples(segments: DataFrame, terms: DataFrame, rules: DefinitionRules) -> DataFrame:
    """Opening rows without a term whose paragraph's first line (``.1``) holds it: ``term`` and the row."""
    openers = paired_paragraphs(segments, rules.opening, rules.answer)
    first = segments.where(F.endswith("segment_id", F.lit(".1"))).select("text_id", paragraph_key(F.col("segment_id")).alias("paragraph"), "text")
    forms = _few_forms(terms)
    if forms is not None:
        about = first.select("text_id", "paragraph", F.explode(_terms_in(F.col("text"), forms)).alias("term")).distinct()
        rows = openers.withColumn("held", _terms_in(F.col("text"), forms)).join(about, ["text_id", "paragraph"])
        columns = ["term", *[c for c in openers.columns if c != "paragraph"]]
        return rows.where(~F.array_contains("held", F.col("term"))).select(*columns)
    each = first.select("text_id", "paragraph", F.explode(F.array_distinct(folded_tokens(F.col("text")))).alias("form"))
    about = _joined(each, terms, ["text_id", "paragraph"]).select("term", "text_id", "paragraph").distinct()
    rows = _joined(openers.join(about, ["text_id", "paragraph"]), terms.select("term", "forms"))
    return rows.where(~F.arrays_overlap(folded_tokens(F.col("text")), "forms")).drop("forms", "paragraph")




def _order() -> list[Column]:
    return [F.desc("score"), F.asc("stratum"), F.asc("text_id"), F.asc("segment_id")]


def dedup_by_text(rows: DataFrame) -> DataFrame:
    """The best row of each term and folded text, and how many more it has (``duplicates``)."""
    key = F.struct((-F.col("score")).alias("s"), "stratum", "text_id", "segment_id")
    best = rows.groupBy("term", fold(F.col("text")).alias("folded")).agg(F.min_by(F.struct(*rows.columns), key).alias("r"), (F.count("*") - 1).alias("duplicates"))
    return best.select("r.*", "duplicates")


def rank_definitions(rows: DataFrame, limit: int, reserved: int | None = None) -> DataFrame:
    """The ``limit`` best rows of each term in a total order, up to ``reserved`` of them rows from context.

    Each class is cut to its own best before the two meet.
    """
    reserved = min(2, limit // 3) if reserved is None else reserved
    own = Window.partitionBy("term", "context").orderBy(*_order())
    rows = rows.withColumn("own", F.row_number().over(own)).where(F.col("own") <= limit)
    held = F.least(F.count_if("context").over(Window.partitionBy("term")), F.lit(reserved))
    rows = rows.withColumn("held", held).where(F.when(F.col("context"), F.col("own") <= F.col("held")).otherwise(F.col("own") <= limit - F.col("held")))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy(*_order()))).drop("own", "held")


def blocks(top: DataFrame, segments: DataFrame, rules: DefinitionRules) -> DataFrame:
    """Ranked rows with the segments around them in order (``block``) and ``detail`` judged by all of these.

    The window becomes places, so that the text is fetched by an equality join.
    """
    has = lambda m: F.array_contains("markers", m)
    sides = (
        F.when(has("predicate"), F.array(F.lit(10), F.lit(2)))
        .when(has("named"), F.array(F.lit(1), F.lit(8)))
        .when(has("interrogative"), F.array(F.lit(2), F.lit(10)))
        .otherwise(F.array(F.lit(4), F.lit(4)))
    )
    keys = top.withColumn("sides", sides)
    places = keys.select("term", "rank", "text_id", F.explode(F.sequence(F.col("pos") - F.col("sides")[0], F.col("pos") + F.col("sides")[1])).alias("pos"))
    around = places.join(segments.select("text_id", "pos", "segment_id", "text"), ["text_id", "pos"])
    tokens = F.arrays_overlap(folded_tokens(F.col("text")), F.array(*map(F.lit, rules.numerals)))
    made = around.groupBy("term", "rank").agg(
        F.sort_array(F.collect_list(F.struct("pos", "segment_id", "text"))).alias("block"), F.max(F.coalesce(tokens, F.lit(False))).alias("lists")
    )
    out = top.join(made, ["term", "rank"])
    return out.withColumn("detail", F.when(F.col("lists"), "enumerative").otherwise("descriptive")).drop("lists")


def scored_definitions(segments: DataFrame, terms: DataFrame, rules: DefinitionRules, similes: bool = True, sources: list[str] | None = None) -> DataFrame:
    """All classified and scored rows, those from context included, before duplicates go."""
    chosen = segments.where(in_sources(F.col("text_id"), sources or []))
    rows = score(classify(candidates(chosen, terms, rules), rules), rules).withColumn("context", F.lit(False))
    if not similes:
        return rows.where("kind != 'simile'")
    more = context_examples(chosen, terms, rules).select(
        "term", "text_id", "segment_id", "pos", "text",
        F.array(F.lit("simile")).alias("markers"), F.lit("simile").alias("kind"), F.lit("descriptive").alias("detail"),
        F.lit(False).alias("closer"), F.lit(rules.proximity).alias("distance"),
    )
    return rows.unionByName(score(more, rules).withColumn("context", F.lit(True)))


def find_definitions(segments: DataFrame, terms: list[str] | DataFrame, rules: DefinitionRules, limit: int = 5, similes: bool = True, sources: list[str] | None = None) -> DataFrame:
    """The best definitions of each term with their context; a term without any has no row."""
    table = term_table(segments.sparkSession, terms, rules)
    top = rank_definitions(dedup_by_text(scored_definitions(segments, table, rules, similes, sources)), limit)
    # few rows, read three times
    return blocks(checkpointed(top), segments, rules)


def sentence_key(text: Column) -> Column:
    """Folded words of a text without the particle that closes a quotation."""
    words = folded_tokens(text)
    last = F.element_at(F.when(F.size(words) > 0, words).otherwise(F.array(F.lit(""))), -1)
    return F.array_join(F.when(last == "ti", F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words), " ")


def merge_same_passage(rows: DataFrame) -> DataFrame:
    """Ranked rows without those that are an earlier kept one again: inside its block, or the same sentence in its text.

    A choice depends on earlier ones, so the rows of a term and text, pruned to
    the best before, go to one small group.
    """
    kept_columns = rows.columns
    keyed = rows.withColumn("sentence", sentence_key(F.col("text"))).withColumn("near", F.col("block.segment_id"))

    def greedy(frame: pd.DataFrame) -> pd.DataFrame:
        keep, seen, sentences = [], set(), set()
        frame = frame.sort_values("rank")
        for anchor, near, sentence in zip(frame["segment_id"], frame["near"], frame["sentence"]):
            new = anchor not in seen and not (sentence and sentence in sentences)
            keep.append(new)
            if new:
                seen.update(near)
                sentences.add(sentence)
        return frame.loc[keep, ["term", "rank"]]

    small = keyed.select("term", "rank", "text_id", "segment_id", "near", "sentence")
    names = small.groupBy("term", "text_id").applyInPandas(greedy, "term string, rank int")
    return rows.join(names, ["term", "rank"], "left_semi").select(*kept_columns)


def definitions_page(segments: DataFrame, terms: list[str], rules: DefinitionRules, titles: DataFrame, limit: int = 5, cap: int | None = None, sources: list[str] | None = None) -> DataFrame:
    """Definitions for a page: more are found than shown, passages merged, ``cap`` a text kept, places reserved, titles added."""
    found = find_definitions(segments, terms, rules, limit * (8 if cap else 3), True, sources)
    merged = merge_same_passage(found)
    if cap:
        own = Window.partitionBy("term", "text_id").orderBy("rank")
        merged = merged.withColumn("n", F.row_number().over(own)).where(F.col("n") <= cap).drop("n")
    merged = merged.withColumnRenamed("rank", "found_rank")
    top = rank_definitions(merged, limit)
    # rows from context come last on a page
    place = Window.partitionBy("term").orderBy("context", *_order())
    top = top.withColumn("rank", F.row_number().over(place)).drop("found_rank")
    return top.join(titles.select("text_id", F.col("text").alias("title")), "text_id", "left")


