"""Outlines by header, natural order, reserved places, neighbours as arrays, fallback matches and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verseloom.functions.text import fold, folded_tokens
from verseloom.operators.needles import needle_hits
from verseloom.operators.search import word_parts
from verseloom.operators.shared import checkpointed, join_counted, request_table

DIGITS = 20  # shorter numbers are padded to so many digits


def natural_key(name: Column) -> Column:
    """A string that sorts runs of digits as numbers: x9 before x10; leading zeros don't count."""
    runs = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit("[0-9]+|[^0-9]+"), F.lit(0))

    def padded(run: Column) -> Column:
        number = F.ltrim(run, F.lit("0"))
        return F.when(run.rlike("^[0-9]"), F.when(F.length(number) < DIGITS, F.lpad(number, DIGITS, "0")).otherwise(number)).otherwise(run)

    return F.array_join(F.transform(runs, padded), "")


def outline_by_header(segments: DataFrame, is_header: Column) -> DataFrame:
    """Sections of each text that headers start; what stands before the first header is part of section 1."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = segments.select("doc_id", "pos", F.coalesce(is_header, F.lit(False)).alias("h"))
    rows = rows.withColumn("section", F.greatest(F.sum(F.col("h").cast("long")).over(w), F.lit(1).cast("long")))
    return rows.groupBy("doc_id", "section").agg(
        F.min(F.when(F.col("h"), F.col("pos"))).alias("header"),
        F.min("pos").alias("first"),
        F.max("pos").alias("last"),
        F.count("*").alias("n"),
    )


def whole_word_or_substring(segments: DataFrame, terms: list[str] | DataFrame) -> DataFrame:
    """Segments with each folded term as a word; for a term that is nowhere a word, those that hold it inside one.

    Terms are a list or ``terms(term)`` of any size. Distinct tokens are matched
    first: by equality, and by the grams of the vocabulary only for terms that no
    token equals; then the tokens found are joined to the segments, the rows of a
    frequent one split. Terms that aren't one token (they have a blank or a sign)
    are looked for in the folded text, all in one pass.
    """
    asked = request_table(segments.sparkSession, terms, "term").withColumn("needle", fold(F.col("term")))
    tokens = segments.select("doc_id", "pos", F.explode(F.array_distinct(folded_tokens(F.col("segment")))).alias("token"))
    vocabulary = checkpointed(tokens.groupBy("token").agg(F.count("*").alias("n")))
    words = vocabulary.join(asked, F.col("token") == F.col("needle")).select("term", "token", "n")
    one = F.col("needle").rlike("^[a-z0-9]+$")
    inside = asked.where(one).join(words.select("term"), "term", "left_anti")
    held = word_parts(vocabulary, inside.select(F.col("needle").alias("part")))
    parts = held.join(inside, F.col("part") == F.col("needle")).join(vocabulary, "token").select("term", "token", "n")
    found = words.withColumn("whole", F.lit(True)).union(parts.withColumn("whole", F.lit(False)))
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hits = join_counted(tokens, found, "token", total, ["doc_id", "pos"]).select("term", "doc_id", "pos", "whole").distinct()
    odd = asked.where(~one & (F.col("needle") != ""))
    more = needle_hits(segments.select("doc_id", "pos", "segment"), {"segment": fold(F.col("segment"))}, odd).join(odd, "needle")
    return hits.union(more.select("term", "doc_id", "pos", F.lit(False)))


def reserve_slots(ranked: DataFrame, limit: int, reserved: int | None = None) -> DataFrame:
    """The ``limit`` best of ``ranked(term, doc_id, score, secondary)`` of each term.

    Up to ``reserved`` places (a third of the limit, 2 at most) go to the best
    secondary rows. Each class is cut to its own best before the classes meet.
    """
    reserved = min(2, limit // 3) if reserved is None else reserved
    best = [F.desc("score"), F.asc("doc_id")]
    own = Window.partitionBy("term", "secondary").orderBy(*best)
    rows = ranked.withColumn("own", F.row_number().over(own)).where(F.col("own") <= limit)
    first = (F.col("secondary") & (F.col("own") <= reserved)).cast("int")
    places = Window.partitionBy("term").orderBy(first.desc(), *best)
    kept = rows.withColumn("place", F.row_number().over(places)).where(F.col("place") <= limit)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy(*best))).select(
        "term", "doc_id", "score", "secondary", "rank"
    )


def neighbour_arrays(segments: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """Each segment with the positions and texts around it, itself included."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-before, after)
    return segments.select("doc_id", "pos", F.collect_list(F.struct("pos", "segment")).over(w).alias("block"))


def export_conversations(turns: DataFrame) -> DataFrame:
    """One JSON document a conversation, with its turns in order; ``write.text`` takes the column ``value``."""
    parts = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    docs = turns.groupBy("conv_id").agg(parts.alias("turns"), F.count("*").alias("n_turns"))
    return docs.select("conv_id", "n_turns", F.to_json(F.struct("conv_id", "turns"), {"ignoreNullFields": "false"}).alias("value"))
