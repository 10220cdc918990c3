"""Counts and listings over the hierarchy, editions and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def structure_counts(docs: DataFrame, segments: DataFrame) -> DataFrame:
    """Texts and segments of each level-2 branch; the segments are counted by text first."""
    sizes = segments.groupBy("doc_id").agg(F.count("*").alias("n"))
    per_text = docs.select("doc_id", "lang", "source").join(sizes, "doc_id", "left")
    return per_text.groupBy("lang", "source").agg(
        F.count("*").alias("n_texts"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_segments")
    )


def text_sizes(docs: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments that aren't blank of each text, 0 kept."""
    n = segments.where(F.trim("segment") != "").groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.select("doc_id").join(n, "doc_id", "left").select(
        "doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_segments")
    )


def edition_stats(editions: DataFrame) -> DataFrame:
    """Rows and distinct texts of each edition."""
    per_text = editions.groupBy("edition", "conv_id").count()
    return per_text.groupBy("edition").agg(
        F.sum("count").cast("long").alias("n_rows"), F.count("*").alias("n_texts")
    )


def compare_editions(editions: DataFrame) -> DataFrame:
    """Each segment's editions in order, and how many."""
    return editions.groupBy("conv_id", "seg").agg(
        F.array_join(F.array_sort(F.collect_list("edition")), ",").alias("editions"), F.count("*").alias("n_editions")
    )


def embedding_progress(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Texts with and without a vector and the share done in percent, by level 1 and in all (level 1 null)."""
    have = vectors.where("embedding is not null").select(F.col("vec_id").alias("doc_id")).distinct()
    marked = docs.select("doc_id", "lang").join(have.withColumn("have", F.lit(1)), "doc_id", "left")
    done = F.count("have")
    return marked.rollup("lang").agg(
        F.count("*").alias("total"), F.count_if(F.col("have").isNull()).alias("missing"), done.alias("done"), F.round(100.0 * done / F.count("*"), 2).alias("percent")
    )


def missing_embeddings(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Ids of the texts without a vector."""
    have = vectors.where("embedding is not null").select(F.col("vec_id").alias("doc_id"))
    return docs.select("doc_id").join(have, "doc_id", "left_anti")


def markup_census(pages: DataFrame) -> DataFrame:
    """How often each start tag occurs."""
    tags = pages.select(F.explode(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))).alias("tag"))
    return tags.groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))


def dedup_by_key(segments: DataFrame, key) -> DataFrame:
    """One segment of each folded text, the first in document order, and how many more there are."""
    at = F.struct("doc_id", "pos")
    found = segments.groupBy(key.alias("k")).agg(F.min(at).alias("at"), (F.count("*") - 1).alias("duplicates"))
    return found.select(F.col("at.doc_id").alias("doc_id"), F.col("at.pos").alias("pos"), "duplicates")
