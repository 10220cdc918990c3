"""Slices and outlines of texts, choice of editions, samples, merges and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verseloom.functions.text import fold, folded_tokens


def context_block(segments: DataFrame, word: str, before: int = 2, after: int = 2) -> DataFrame:
    """Segments within reach of one that holds the folded word; one window over each text, no self-join."""
    rows = segments.select("doc_id", "pos", F.array_contains(folded_tokens(F.col("segment")), word).alias("is_anchor"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-after, before)
    return rows.withColumn("near", F.max("is_anchor").over(w)).where("near").select("doc_id", "pos", "is_anchor")


def text_page(segments: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of each text, with its size and where the next page starts (null: nowhere)."""
    total = F.count("*").over(Window.partitionBy("doc_id"))
    rows = segments.select("doc_id", "pos", total.alias("total")).where(F.col("pos").between(offset, offset + limit - 1))
    return rows.withColumn("next_offset", F.when(F.col("total") > offset + limit, F.lit(offset + limit).cast("long")))


def outline_by_key(turns: DataFrame) -> DataFrame:
    """Runs of turns with the same role: number, role, first and last turn, size."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    changed = (~F.col("role").eqNullSafe(F.lag("role").over(w))) | F.lag("turn").over(w).isNull()
    runs = turns.select("conv_id", "turn", "role", changed.cast("long").alias("c")).withColumn("section", F.sum("c").over(w))
    return runs.groupBy("conv_id", "section").agg(
        F.min("role").alias("role"), F.min("turn").alias("first"), F.max("turn").alias("last"), F.count("*").alias("n")
    )


def pick_edition(editions: DataFrame, order: list[str]) -> DataFrame:
    """How many texts take each edition, when a text takes the first of a list that it has."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("edition"))
    best = editions.where(F.col("edition").isin(order)).groupBy("conv_id").agg(F.min(rank).alias("r"))
    return best.groupBy(F.get(F.array(*map(F.lit, order)), F.col("r").cast("int") - 1).alias("edition")).agg(
        F.count("*").alias("n_texts")
    )


def paired_passages(segments: DataFrame, opening: str, closing: str) -> DataFrame:
    """Texts with a segment that holds the opening word and one that holds the closing word; how many, the first opening."""
    tokens = folded_tokens(F.col("segment"))
    rows = segments.select(
        "doc_id", "pos", F.array_contains(tokens, opening).alias("o"), F.array_contains(tokens, closing).alias("c")
    )
    found = rows.groupBy("doc_id").agg(
        F.count_if("o").alias("n_open"), F.count_if("c").alias("n_close"), F.min(F.when(F.col("o"), F.col("pos"))).alias("first_open")
    )
    return found.where("n_open > 0 AND n_close > 0")


def one_per_text(segments: DataFrame, seed: str, k: int) -> DataFrame:
    """One segment of each text and k texts, both by a repeatable hash."""
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id"), F.col("pos")))
    best = segments.groupBy("doc_id").agg(F.min(F.struct(key.alias("h"), "pos")).alias("m"))
    return best.orderBy("m.h", "doc_id").limit(k).select("doc_id", F.col("m.pos").alias("pos"))


def cap_per_text(hits: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` hits of a term in a text, the first in order."""
    w = Window.partitionBy("term", "scope", "doc_id").orderBy("pos")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).select("term", "scope", "doc_id", "pos")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows lost and gained between two results of the same columns."""
    return before.exceptAll(after).withColumn("change", F.lit("lost")).union(
        after.exceptAll(before).withColumn("change", F.lit("gained"))
    )


def sections_listing(docs: DataFrame) -> DataFrame:
    """Collections of each language in order, and how many texts they have."""
    per = docs.groupBy("lang", "source").agg(F.count("*").alias("n"))
    return per.groupBy("lang").agg(
        F.array_join(F.sort_array(F.collect_list("source")), ",").alias("sources"), F.sum("n").cast("long").alias("n_texts")
    )


def embedding_input(*texts: Column) -> Column:
    """Texts that aren't blank, joined with a bar."""
    return F.concat_ws(" | ", *[F.when(F.trim(t) != "", t) for t in texts])


def coverage(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Tokens of each text, and how many of them are entries of ``dictionary(token)``.

    Joined on counts by text, so a frequent token is one row of a text; Spark
    splits skewed partitions of the join.
    """
    counts = docs.select("doc_id", F.explode(folded_tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").count()
    marked = counts.join(dictionary.select("token", F.lit(1).alias("known")), "token", "left")
    return marked.groupBy("doc_id").agg(
        F.sum("count").cast("long").alias("n_tokens"), F.sum(F.col("count") * F.coalesce("known", F.lit(0))).cast("long").alias("n_known")
    )


def corpus_checks(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Number of rows that break each rule."""
    ids = docs.groupBy("doc_id").count()
    rules = docs.agg(
        F.count_if(F.col("doc_id").isNull()).alias("null id"),
        F.count_if(F.col("text").isNull()).alias("null text"),
        F.count_if(F.trim("text") == "").alias("blank text"),
        F.count_if(F.length("text") != F.col("n_chars")).alias("wrong length"),
    )
    out = rules.unpivot([], rules.columns, "rule", "n")
    out = out.union(ids.where("count > 1").agg(F.lit("repeated id"), F.count("*")))
    lost = vectors.join(ids, vectors["vec_id"] == ids["doc_id"], "left_anti")
    return out.union(lost.agg(F.lit("vector without text"), F.count("*")))
