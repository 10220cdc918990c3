"""Quality rules: a table of thresholds compiled into one projection of Spark functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verseloom.llm.common import WORD_SPACE, word_array

#: Frequent function words of the languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that for it on with as are this be at or from was "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un du une que est pour qui dans sur par au pas avec "
    "el y los se del las por con no una su para es al lo como más o"
).split()
#: As they stand in a text: in lower case or with a capital.
STOP_WORDS = sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= metric <= high``; an open end is None."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: Metrics: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words,
#: mean_word_chars, symbol_ratio (of word_chars), dup_line_ratio, repeat_word_ratio,
#: stop_word_ratio. Ratios of an empty text are 0.
RULES = (
    Rule("mean word length", "mean_word_chars", 2.0, 20.0),
    Rule("symbols", "symbol_ratio", high=0.10),
    Rule("stop words", "stop_word_ratio", low=0.01),
    Rule("repeated lines", "dup_line_ratio", high=0.50),
)


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def _repeat_words(df: DataFrame, hash_bits: int = 64) -> DataFrame:
    """Add ``n_repeat_words``: words inside 3-word windows that the text holds twice or more.

    A window becomes one long: the upper bits of its 64-bit hash above its
    position, so a sort of plain longs puts equal windows side by side. Position
    bits are as many as the text needs. Windows of equal bits are then compared
    by their words; a text in which two differ sorts the words themselves.
    """
    df = df.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    df = df.withColumn("__b", F.length(F.bin(F.col("n_words"))))
    df = df.withColumn("__mask", F.expr("shiftleft(1L, __b) - 1"))
    df = df.withColumn("__high", F.bitwise_not("__mask").bitwiseAND(F.lit(-1 << (64 - hash_bits))))
    places = F.sequence(F.lit(0), F.greatest(F.col("n_words").cast("int") - 3, F.lit(0)))
    window = F.transform(
        places,
        lambda i: F.xxhash64(F.get("__h", i), F.get("__h", i + 1), F.get("__h", i + 2))
        .bitwiseAND(F.col("__high"))
        .bitwiseOR(i),
    )
    none = F.array().cast("array<bigint>")
    df = df.withColumn("__s", F.when(F.col("n_words") >= 4, F.sort_array(window)).otherwise(none))

    def equal(x: Column, y: Column) -> Column:
        return x.bitwiseXOR(y).bitwiseAND(F.col("__high")) == 0

    def words(x: Column) -> Column:
        return F.slice("__w", (x.bitwiseAND(F.col("__mask")) + 1).cast("int"), F.lit(3))

    df = df.withColumn("__some", F.size(F.filter("__s", lambda x, k: equal(x, F.get("__s", k + 1)))) > 0)
    differ = F.filter("__s", lambda x, k: equal(x, F.get("__s", k + 1)) & (words(x) != words(F.get("__s", k + 1))))
    df = df.withColumn("__clash", F.when(F.col("__some"), F.size(differ) > 0).otherwise(F.lit(False)))

    def again(rows: str, same, place) -> Column:
        """Places of the rows of a sorted array that equal the row before or behind."""
        at = F.transform(
            rows,
            lambda x, k: F.when(
                F.coalesce(same(x, F.get(rows, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(rows, k + 1)), F.lit(False)),
                place(x),
            ).otherwise(F.lit(-1)),
        )
        return F.sort_array(F.filter(at, lambda x: x >= 0))

    spelt = F.transform(places, lambda i: F.struct(F.slice("__w", i + 1, F.lit(3)).alias("t"), i.cast("long").alias("p")))
    df = df.withColumn("__z", F.when(F.col("__clash"), F.sort_array(spelt)))
    df = df.withColumn(
        "__p",
        F.when(F.col("__clash"), again("__z", lambda x, y: x["t"] == y["t"], lambda x: x["p"]))
        .when(F.col("__some"), again("__s", equal, lambda x: x.bitwiseAND(F.col("__mask"))))
        .otherwise(none),
    )
    gaps = F.transform("__p", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("__p", k + 1) - x, F.lit(3))))
    total = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)
    made = ("__h", "__b", "__mask", "__high", "__s", "__some", "__clash", "__z", "__p")
    return df.withColumn("n_repeat_words", total).drop(*made)


def measure(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """``doc_id`` and the metrics of ``RULES`` for each row; a null text has no words or lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", text.alias("__t"), word_array(F.col("text")).alias("__w"))
    df = df.withColumn("n_words", F.size("__w").cast("long"))
    df = df.withColumn("__l", F.filter(F.split("__t", "\n", -1), lambda x: F.btrim(x, F.lit(WORD_SPACE)) != ""))
    stop = F.filter("__w", lambda w: w.isin(STOP_WORDS))
    df = df.select(
        "doc_id",
        "__w",
        "n_words",
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size(stop).cast("long").alias("n_stop_words"),
    )
    return _repeat_words(df, hash_bits).drop("__w")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, the metrics, ``base_failed``, ``failed`` (names of broken rules) and ``kept``.

    One row for each row of ``docs``, repeated rows and null ids included;
    columns other than ``doc_id`` and ``text`` are not read. Null, empty and
    blank texts have zero in every metric and fail the base rule. An empty table
    gives an empty result.
    """
    df = measure(docs)
    df = df.withColumns(
        {
            "mean_word_chars": _ratio("word_chars", "n_words"),
            "symbol_ratio": _ratio("n_symbols", "word_chars"),
            "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
            "repeat_word_ratio": _ratio("n_repeat_words", "n_words"),
            "stop_word_ratio": _ratio("n_stop_words", "n_words"),
            "base_failed": (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        }
    )
    broken = []
    for r in rules:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (F.col(r.metric) < r.low)
        if r.high is not None:
            bad = bad | (F.col(r.metric) > r.high)
        broken.append(F.when(bad, F.lit(r.name)))
    df = df.withColumn("failed", F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>"))
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their own columns whatever the names; no join.

    Null, empty and blank texts fail the base rule and go; a repeated row stays as
    often as it stands; an empty table stays empty.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id")
    judged = judge(docs.select(whole, F.col("text")), rules)
    # a column that no filter is pushed below: else the condition is expanded into all that it is made of
    judged = judged.withColumn("__n", F.monotonically_increasing_id())
    kept = judged.where(F.col("kept") & (F.col("__n") >= 0))
    return kept.select(*[F.col("doc_id").getField(c).alias(c) for c in docs.columns])


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    df = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_STOP_LIST = ", ".join(f"'{w}'" for w in STOP_WORDS)
SPACES = r"[\x20\x09-\x0D]"


def oracle_base(table: str = "documents") -> str:
    """DuckDB twin of ``judge``, as a chain of common table expressions ending in ``judged``."""
    return rf"""
texts AS (SELECT doc_id, coalesce(text, '') AS t FROM {table}),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
  SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM texts)),
tri AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS g
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri WHERE g IS NOT NULL) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS x(k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM texts)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
per_word AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars,
  count(*) FILTER (w IN ({_STOP_LIST})) AS n_stop FROM words GROUP BY doc_id),
base AS (SELECT t.doc_id, coalesce(p.n_words, 0)::BIGINT AS n_words, coalesce(p.word_chars, 0)::BIGINT AS word_chars,
  length(regexp_replace(t.t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(l.n_lines, 0)::BIGINT AS n_lines, coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(p.n_stop, 0)::BIGINT AS n_stop
  FROM texts t LEFT JOIN per_word p USING (doc_id) LEFT JOIN lines l USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
verdict AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed
  FROM base),
judged AS (SELECT *, (NOT base_failed
  AND word_chars / n_words BETWEEN {RULES[0].low} AND {RULES[0].high}
  AND n_symbols / word_chars <= {RULES[1].high}
  AND n_stop / n_words >= {RULES[2].low}
  AND n_dup_lines / n_lines <= {RULES[3].high}) AS kept FROM verdict)"""


OP1_SQL = f"""WITH {oracle_base()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"""
