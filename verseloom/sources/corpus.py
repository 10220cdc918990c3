"""The test tables as a corpus: texts, their segments, editions and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(docs: DataFrame) -> DataFrame:
    """One row a line: text id, dense position, level-1 and level-2 keys, text. Built without a shuffle."""
    return docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n", -1)).alias("pos", "segment"))


def editions(conversations: DataFrame) -> DataFrame:
    """Segment key, edition and text of each translation."""
    return conversations.select(
        "conv_id", F.expr("turn div 2").alias("seg"), F.col("role").alias("edition"), F.col("text")
    )


def cited(docs: DataFrame) -> DataFrame:
    """Segments of ``docs`` with ids that carry structure, in three shapes by ``doc_id``.

    Every third text has header rows (``en3:2.0``), every third none (``en4:2.1``),
    and every third is a range whose segments name its members (``en5-14``: ``en6:1.2``).
    """
    s = segments(docs).withColumn("l", F.coalesce("lang", F.lit("xx"))).withColumn("k", F.expr("pmod(doc_id, 3)"))
    header = F.concat_ws(".", F.expr("pos div 5"), F.expr("pos % 5"))
    number = F.concat_ws(".", F.expr("pos div 4"), F.expr("pos % 4 + 1"))
    member = F.concat("l", F.expr("doc_id + pos div 6"))
    text_id = F.when(F.col("k") == 2, F.concat("l", "doc_id", F.lit("-"), F.expr("doc_id + 9"))).otherwise(F.concat("l", "doc_id"))
    segment_id = (
        F.when(F.col("k") == 0, F.concat("l", "doc_id", F.lit(":"), header))
        .when(F.col("k") == 1, F.concat("l", "doc_id", F.lit(":"), number))
        .otherwise(F.concat(member, F.lit(":1."), F.expr("pos % 6 + 1")))
    )
    return s.select(text_id.alias("text_id"), segment_id.alias("segment_id"), "pos", F.col("segment").alias("text"), "lang", "source", "doc_id")


def read_text_tree(spark: SparkSession, path: str) -> DataFrame:
    """A tree of JSON files ``{segment id: text}``: ``text_id``, ``collection``, ``edition``, ``path``, ``segment_id``, ``pos``, ``text``.

    The text id is the file's name up to its first underscore, the edition what
    follows, the collection its folder. Keys keep their order in ``pos``. A file
    that is no such object gives no rows.
    """
    files = (
        spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
        .select("value", F.col("_metadata.file_path").alias("path"))
    )
    name = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    entries = F.posexplode(F.map_entries(F.from_json("value", "map<string,string>")))
    return files.select(
        F.substring_index(name, "_", 1).alias("text_id"),
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("collection"),
        F.regexp_extract(name, r"^[^_]*_(.*)$", 1).alias("edition"),
        "path",
        entries.alias("pos", "e"),
    ).select("text_id", "collection", "edition", "path", F.col("e.key").alias("segment_id"), "pos", F.col("e.value").alias("text"))


def assign_collection(rows: DataFrame, listed: tuple[tuple[str, str], ...]) -> DataFrame:
    """Texts of ``listed(text_id, collection)`` go to the named collection, others stay in that of their folder."""
    table = rows.sparkSession.createDataFrame(list(listed), "text_id string, named string")
    return rows.join(F.broadcast(table), "text_id", "left").withColumn("collection", F.coalesce("named", "collection")).drop("named")
