"""Loading: upserts with repeated keys, editions, dictionaries, postings with statistics, table exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from verseloom.functions.text import folded_tokens
from verseloom.operators.shared import checkpointed


def last_rows(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that comes last by ``order``; rows with a null key go. Ties go by all columns."""
    there = rows.dropna(subset=keys)
    others = [c for c in rows.columns if c not in keys and c != order]
    best = there.groupBy(*keys).agg(F.max(F.struct(order, *others)).alias("m"))
    return best.select(*keys, F.col(f"m.{order}").alias(order), *[F.col(f"m.{c}").alias(c) for c in others])


def upsert(base: DataFrame, new: DataFrame, keys: list[str], order: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """``base`` with the rows of ``new``, the last of each key; a known key takes the new values but those ``kept``.

    ``base`` has unique keys; ``new`` has its columns and ``order``, the order of
    loading. The result is a new table: write it beside the old one.
    """
    values = [c for c in base.columns if c not in keys]
    last = last_rows(new, keys, order).select(*keys, *[F.col(c).alias(f"new_{c}") for c in values], F.lit(True).alias("is_new"))
    old = base.select("*", F.lit(True).alias("is_old"))
    joined = old.join(last, keys, "full_outer")

    def value(c: str) -> Column:
        take = F.col("is_new") if c not in kept else F.col("is_new") & F.col("is_old").isNull()
        return F.when(F.coalesce(take, F.lit(False)), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*keys, *map(value, values))


def merge_into(path: str, new: DataFrame, keys: list[str], partition: str, order: str, kept: tuple[str, ...] = ()) -> None:
    """Merge rows into the Parquet table at ``path``, partitioned by ``partition``, which is one of the ``keys``, so no row changes its partition.

    ``new`` has the table's columns and ``order``, the order of loading; the last
    row of each key counts, and a known key keeps the columns ``kept`` (its
    position, say). Only partitions with a new row are read and written again: all
    others keep their files. What is to be written is checkpointed before the
    first file goes, so a run that fails can be taken up again.
    """
    if partition not in keys:
        raise ValueError("the partition is one of the keys")
    columns = [f for f in new.schema.fields if f.name != order]
    base = new.sparkSession.read.schema(StructType(columns)).parquet(path)
    there = checkpointed(new.dropna(subset=keys))
    touched = there.select(partition).distinct()
    merged = checkpointed(upsert(base.join(touched, partition, "left_semi"), there, keys, order, kept))
    rows = merged.select(*[f.name for f in columns])
    rows.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def upsert_translations(base: DataFrame, new: DataFrame, segments: DataFrame, order: str) -> DataFrame:
    """Edition rows of known segments, unique by (segment, language, edition); those of unknown segments are dropped."""
    known = new.join(segments.select("segment_id").distinct(), "segment_id", "left_semi")
    return upsert(base, known, ["segment_id", "language", "edition"], order)


def dictionary_rows(entries: DataFrame, source: str, language: str, clean, lower: bool = True) -> DataFrame:
    """Rows for a dictionary from ``entries(word, text)``: entries without word or text go; ``clean`` is applied to the text."""
    rows = entries.where((F.col("word") != "") & (F.col("text") != ""))
    word = F.regexp_replace(F.col("word"), r"^\s+|\s+$", "")
    return rows.select(
        (F.lower(word) if lower else word).alias("word"), F.lit(language).alias("language"), clean(F.col("text")).alias("text"), F.lit(source).alias("source")
    )


def replace_source(rows: DataFrame, path: str) -> None:
    """Write dictionary rows to a table by source, replacing the sources that occur and no other."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def seed_dims(known: DataFrame, seeds: list[tuple], code: str) -> DataFrame:
    """A level of the hierarchy with some fixed rows, which replace those of the same code."""
    schema = StructType([*known.schema.fields, StructField("loaded", LongType())])
    made = known.sparkSession.createDataFrame([(*row, k) for k, row in enumerate(seeds)], schema)
    return upsert(known, made, [code], "loaded")


def build_postings(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Folded tokens of some text columns: ``token``, ``field``, the key, sorted ``positions`` and ``size``, the row's tokens in all columns."""
    arrays = [folded_tokens(F.col(c)) for c in columns]
    size = F.size(arrays[0])
    for a in arrays[1:]:
        size = size + F.size(a)
    fields = F.array(*[F.struct(F.lit(c).alias("field"), a.alias("tokens")) for c, a in zip(columns, arrays)])
    each = rows.select(key, size.alias("size"), F.explode(fields).alias("f")).select(key, "size", "f.field", F.posexplode("f.tokens").alias("at", "token"))
    return each.groupBy("token", "field", key).agg(F.sort_array(F.collect_list("at")).alias("positions"), F.first("size").alias("size"))


def posting_statistics(postings: DataFrame, key: str) -> DataFrame:
    """Rows and occurrences of each token."""
    per_row = postings.groupBy("token", key).agg(F.sum(F.size("positions")).alias("n"))
    return per_row.groupBy("token").agg(F.count("*").alias("df"), F.sum("n").cast("long").alias("n"))


def token_statistics(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows and occurrences of each folded token of some text columns, counted without positions."""
    tokens = F.flatten(F.array(*[folded_tokens(F.col(c)) for c in columns]))
    per_row = rows.select(key, F.explode(tokens).alias("token")).groupBy("token", key).agg(F.count("*").alias("n"))
    return per_row.groupBy("token").agg(F.count("*").alias("df"), F.sum("n").cast("long").alias("n"))


def _save(rows: DataFrame, name: str, path: str | None, buckets: int = 0, mode: str = "overwrite") -> None:
    writer = rows.write.mode(mode)
    if path:
        writer = writer.option("path", f"{path}/{name}")
    if buckets:
        writer = writer.bucketBy(buckets, "token").sortBy("token")
    writer.saveAsTable(name)


def write_index(rows: DataFrame, key: str, columns: list[str], name: str, buckets: int, path: str | None = None, mode: str = "overwrite") -> None:
    """Save the word index of some text columns as three tables: postings, bucketed and sorted by token; sizes of rows; statistics of tokens.

    ``mode`` "append" adds the rows as another batch; ``add_to_index`` sees to it
    that no row is added twice.
    """
    _save(build_postings(rows, key, columns), f"{name}_postings", path, buckets, mode)
    size = F.lit(0)
    for c in columns:
        size = size + F.size(folded_tokens(F.col(c)))
    _save(rows.select(key, size.alias("size")), f"{name}_sizes", path, 0, mode)
    _save(token_statistics(rows, key, columns), f"{name}_statistics", path, buckets, mode)


def add_to_index(rows: DataFrame, key: str, columns: list[str], name: str, buckets: int, path: str | None = None) -> None:
    """Add the ``rows`` that the index doesn't have yet; those it has keep their postings. No file is rewritten.

    The keys are told apart before anything is written, so that the three tables
    get the same rows.
    """
    known = rows.sparkSession.table(f"{name}_sizes").select(key)
    new = checkpointed(rows.select(key, *columns).join(known, key, "left_anti").dropDuplicates([key]))
    write_index(new, key, columns, name, buckets, path, "append")


def read_index(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, sizes and statistics of an index; a filter on ``token`` reads its buckets only."""
    parts = spark.table(f"{name}_statistics")
    statistics = parts.groupBy("token").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    return spark.table(f"{name}_postings"), spark.table(f"{name}_sizes"), statistics


def export_tables(tables: dict[str, tuple[DataFrame, list[str]]], path: str) -> DataFrame:
    """Write the chosen columns of each table as Parquet in id order, and tell how many rows each has."""
    found = None
    for name, (table, columns) in tables.items():
        table.select(*columns).repartitionByRange(columns[0]).sortWithinPartitions(columns[0]).write.mode("overwrite").parquet(f"{path}/{name}")
        part = table.sparkSession.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        found = part if found is None else found.union(part)
    return found


def union_hits(*parts: DataFrame) -> DataFrame:
    """Rows of any of some results, each once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def match_any_token(rows: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows that hold any of the query's tokens (cut at blanks and hyphens, of 3 letters or more; else all of it) in any column, whatever the case."""
    tokens = [t for t in query.replace("-", " ").split() if len(t) >= 3] or [query.strip()]
    found = F.lit(False)
    for t in tokens if tokens[0] else []:
        for c in columns:
            found = found | F.coalesce(F.contains(F.lower(c), F.lower(F.lit(t))), F.lit(False))
    return rows.where(found)


def search_substring(rows: DataFrame, needle: str, root: str, other: str, fold, k: int = 50) -> DataFrame:
    """The first ``k`` rows in order whose folded root or other text holds the folded needle, and which does (the root first).

    A needle of fewer than three characters finds nothing.
    """
    text = fold(F.lit(needle))
    in_root, in_other = F.contains(fold(F.col(root)), text), F.contains(fold(F.col(other)), text)
    hits = rows.where((F.length(text) >= 3) & (in_root | in_other)).withColumn("matched", F.when(in_root, root).otherwise(other))
    return hits.orderBy("text_id", "pos").limit(k)
