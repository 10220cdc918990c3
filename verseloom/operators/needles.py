"""Many needles in one pass: which of any number of strings a text holds.

The needles become one automaton, so a text is read once whatever their number. It
is built from lists of bounded size; longer lists take several passes.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verseloom.functions.text import fold
from verseloom.operators.shared import in_passes

LETTERS = 5_000_000  # of the needles of one pass, about


@lru_cache(maxsize=2)
def _automaton(needles: tuple[str, ...]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for needle in needles:
        automaton.add_word(needle, needle)
    automaton.make_automaton()
    return automaton


def held(text: Column, needles: Broadcast) -> Column:
    """The distinct needles (a broadcast tuple, none of them empty) that stand in a text, sorted; none in a null one."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        automaton = _automaton(needles.value)
        return pd.Series([sorted({n for _, n in automaton.iter(t)}) if t else [] for t in texts], index=texts.index, dtype=object)

    return run(text)


def needle_hits(rows: DataFrame, texts: dict[str, Column], needles: DataFrame, letters: int = LETTERS) -> DataFrame:
    """``rows`` with ``needle`` and ``field``: once for each needle of ``needles(needle)`` that some of ``texts`` holds, and the first that does.

    Null and empty needles are in no text. The texts are read once a pass; a
    pass has about ``letters`` letters of needles.
    """
    spark, out = rows.sparkSession, None
    for found in in_passes(needles.where("needle != ''"), "needle", letters):
        known = spark.sparkContext.broadcast(tuple(sorted(found)))
        lists = [held(text, known).alias(f"__in_{name}") for name, text in texts.items()]
        there = rows.select("*", *lists)
        every = F.array_distinct(F.flatten(F.array(*[f"__in_{name}" for name in texts])))
        first = F.lit(None).cast("string")
        for name in reversed(texts):
            first = F.when(F.array_contains(f"__in_{name}", F.col("needle")), F.lit(name)).otherwise(first)
        part = there.withColumn("needle", F.explode(every)).select(*rows.columns, "needle", first.alias("field"))
        out = part if out is None else out.union(part)
    if out is None:
        return rows.select("*", F.lit("").alias("needle"), F.lit("").alias("field")).limit(0)
    return out


def search_substrings(rows: DataFrame, requests: DataFrame, columns: list[str], order: list[str], k: int = 50) -> DataFrame:
    """For each of ``requests(request_id, needle)`` the first ``k`` rows by ``order`` that hold the folded needle, and in which column (the first of ``columns``).

    Blanks around a needle don't count; one of fewer than three letters, and a null
    one, finds nothing. Requests of any number are answered together.
    """
    needle = fold(F.regexp_replace("needle", r"^\s+|\s+$", ""))
    asked = requests.where("needle is not null").select("request_id", needle.alias("needle")).where(F.length("needle") >= 3)
    hits = needle_hits(rows, {c: fold(F.col(c)) for c in columns}, asked).join(asked, "needle")
    w = Window.partitionBy("request_id").orderBy(*order)
    ranked = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("request_id", "rank", *rows.columns, F.col("field").alias("matched"))


def query_tokens(query: Column) -> Column:
    """Tokens of a query in lower case, cut at blanks and hyphens: those of three letters or more, or else the query as it is."""
    trimmed = F.lower(F.regexp_replace(F.coalesce(query, F.lit("")), r"^\s+|\s+$", ""))
    tokens = F.array_distinct(F.filter(F.split(trimmed, r"[\s\-]+"), lambda t: F.length(t) >= 3))
    whole = F.when(trimmed != "", F.array(trimmed)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(tokens) > 0, tokens).otherwise(whole)


def match_any_tokens(rows: DataFrame, requests: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """``request_id`` and the ``keys`` of each row that holds a token of its ``requests(request_id, query)`` in some column, whatever the case.

    Blank and null queries find nothing. Rows are told apart by ``keys``.
    """
    asked = requests.select("request_id", F.explode(query_tokens(F.col("query"))).alias("needle"))
    hits = needle_hits(rows.select(*keys, *[c for c in columns if c not in keys]), {c: F.lower(F.col(c)) for c in columns}, asked)
    return hits.select(*keys, "needle").join(asked, "needle").select("request_id", *keys).distinct()
