"""Dictionary lookup over the distinct vocabulary, word reports and coverage."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verseloom.functions.text import Kept
from verseloom.operators.search import word_parts
from verseloom.operators.shared import BROADCAST_ROWS, checkpointed

#: Fixed value: all white space.
BLANKS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def unify_nasal(word: Column) -> Column:
    """The two ways to write the nasal as one."""
    return F.replace(word, F.lit("ṁ"), F.lit("ṃ"))


def dictionary_tokens(text: Column) -> Column:
    """Distinct words of a text as a dictionary has them, in first-seen order: lower case, no signs at the ends, two letters or more."""
    parts = F.split(F.coalesce(text, F.lit("")), BLANKS)
    bare = F.transform(parts, lambda p: unify_nasal(F.lower(F.regexp_replace(p, r"^[^\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}]+$", ""))))
    return F.array_distinct(F.filter(bare, lambda w: F.length(w) >= 2))


_blanks = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), BLANKS))


def _inside(letter: str) -> bool:
    return unicodedata.category(letter)[0] in "LNM"


def _bare(part: str) -> str:
    """A word without signs at its ends, as ``dictionary_tokens`` has it."""
    low, high = 0, len(part)
    while low < high and not _inside(part[low]):
        low += 1
    while low < high and not _inside(part[high - 1]):
        high -= 1
    return part[low:high].lower().replace("ṁ", "ṃ")


def _counts(text: Column, known: Broadcast, rules: tuple) -> Column:
    """A text's dictionary words, and how many have an entry directly or by a lemma; nothing for a text without words."""
    ordered = sorted(rules, key=lambda r: -len(r[0]))

    def found(word: str) -> str:
        if word in known.value:
            return "direct"
        for suffix, vowel, _ in ordered:
            if word.endswith(suffix) and len(word) >= len(suffix) + 2 and word[: len(word) - len(suffix)] + vowel in known.value:
                return "lemma"
        return ""

    @F.pandas_udf("array<struct<n long, direct long, lemma long>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bare, entry = Kept(_bare), Kept(found)
        for texts in parts:
            out = []
            for text in texts:
                words = {w for w in map(bare.__getitem__, set(_blanks.split(text or ""))) if len(w) >= 2}
                c = Counter(map(entry.__getitem__, words))
                out.append([{"n": len(words), "direct": c["direct"], "lemma": c["lemma"]}] if words else [])
            yield pd.Series(out, index=texts.index, dtype=object)

    return run(text)


def candidate_lemmas(word: Column, rules: tuple) -> Column:
    """Possible lemmas of a word, that of the longest suffix first: (lemma, suffix, case); two letters of the stem stay."""
    ordered = sorted(rules, key=lambda r: -len(r[0]))

    def one(suffix: str, vowel: str, case: str) -> Column:
        stem = F.substr(word, F.lit(1), F.length(word) - len(suffix))
        made = F.struct(F.concat(stem, F.lit(vowel)).alias("lemma"), F.lit(suffix).alias("suffix"), F.lit(case).alias("case"))
        return F.when(F.endswith(word, F.lit(suffix)) & (F.length(word) >= len(suffix) + 2), made)

    return F.array_compact(F.array(*[one(*r) for r in ordered]))


def candidate_stems(word: Column, rules: tuple, shortened: tuple = ()) -> Column:
    """Sorted distinct stems that a word may have, itself included, and the sorted suffixes that matched."""
    low = F.lower(F.trim(word))
    stems, suffixes = [F.array(low)], []
    none = F.array().cast("array<string>")
    for suffix, endings in rules:
        fits = F.endswith(low, F.lit(suffix)) & (F.length(low) > len(suffix) + 1)
        base = F.substr(low, F.lit(1), F.length(low) - len(suffix))
        stems.append(F.when(fits, F.array(*[F.concat(base, F.lit(e)) for e in endings])).otherwise(none))
        suffixes.append(F.when(fits, F.array(F.lit(suffix))).otherwise(none))
    for suffix, vowel in shortened:
        fits = F.endswith(low, F.lit(suffix))
        base = F.substr(low, F.lit(1), F.length(low) - len(suffix))
        stems.append(F.when(fits, F.array(F.concat(base, F.lit(vowel)))).otherwise(none))
        suffixes.append(F.when(fits, F.array(F.lit(suffix))).otherwise(none))
    flat = lambda parts: F.sort_array(F.array_distinct(F.flatten(F.array(*parts))))
    return F.struct(flat(stems).alias("stems"), flat(suffixes).alias("suffixes"))


def lookup_words(words: DataFrame, dictionary: DataFrame, rules: tuple) -> DataFrame:
    """For each distinct ``word`` its entry: itself, or else the lemma of the longest suffix that has one.

    ``entry`` is null for words without. One equality join with the distinct
    words of ``dictionary(word)``, whatever the length of a word.
    """
    asked = words.select(unify_nasal(F.col("word")).alias("word")).where("word != ''").distinct()
    exact = F.array(F.struct(F.col("word").alias("lemma"), F.lit(None).cast("string").alias("suffix"), F.lit(None).cast("string").alias("case")))
    tried = asked.select("word", F.posexplode(F.concat(exact, candidate_lemmas(F.col("word"), rules))).alias("r", "c"))
    tried = tried.select("word", "r", "c.lemma", "c.suffix", "c.case")
    known = dictionary.select(F.col("word").alias("lemma")).distinct()
    best = tried.join(known, "lemma").groupBy("word").agg(F.min(F.struct("r", "lemma", "suffix", "case")).alias("m"))
    return asked.join(best, "word", "left").select(
        "word", F.col("m.lemma").alias("entry"), F.col("m.suffix").alias("suffix"), F.col("m.case").alias("case")
    )


def dictionary_coverage(texts: DataFrame, dictionary: DataFrame, rules: tuple, key: str = "doc_id", few: int = BROADCAST_ROWS) -> DataFrame:
    """Words of each text, and those with an entry, directly or by a lemma.

    A dictionary of up to ``few`` words goes to all tasks, which count a text where
    it lies. With more, distinct words are looked up once for the corpus. Words of a text count once,
    so a frequent word is one row of a text in the join back; Spark splits its
    partition there.
    """
    words = checkpointed(dictionary.select("word").where("word is not null").distinct())
    if words.count() <= few:
        known = texts.sparkSession.sparkContext.broadcast(frozenset(r["word"] for r in words.collect()))
        counts = texts.select(key, F.explode(_counts(F.col("text"), known, rules)).alias("c"))
        return counts.groupBy(key).agg(F.sum("c.n").alias("n_words"), F.sum("c.direct").alias("n_direct"), F.sum("c.lemma").alias("n_lemma"))
    tokens = texts.select(key, F.explode(dictionary_tokens(F.col("text"))).alias("word"))
    found = lookup_words(tokens, dictionary, rules).where("entry is not null").select("word", F.col("suffix").isNull().alias("direct"))
    return tokens.join(found, "word", "left").groupBy(key).agg(
        F.count("*").alias("n_words"), F.count_if("direct").alias("n_direct"), F.count_if(~F.col("direct")).alias("n_lemma")
    )


def word_report(words: list[str], dictionary: DataFrame, texts: DataFrame, examples: int = 3, related: int = 5, attributions: DataFrame | None = None) -> DataFrame:
    """For each word: its entries, suggestions where it has none, related words, and one example of so many texts.

    ``dictionary(word, source, text)``; ``texts(text_id, pos, folded tokens)``.
    Examples hold the word as a token; only for a word that no text has so, as a
    part of one. ``attributions(source, ...)`` adds what is known of each source
    that an entry is from. Words are the caller's list (1,000 at most) and become
    literals.
    """
    if len(words) > 1000:
        raise ValueError("at most 1000 words a call")
    spark = dictionary.sparkSession
    asked = spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "asked string")
    entry = F.struct("source", "text")
    entries = dictionary.join(F.broadcast(asked), F.col("word") == F.col("asked")).groupBy("asked").agg(F.sort_array(F.collect_set(entry)).alias("entries"))
    mine = F.filter(F.array(*map(F.lit, dict.fromkeys(words))), lambda a: F.contains("word", a) & (F.col("word") != a))
    near = dictionary.select("word").distinct().select("word", F.explode(mine).alias("asked"), F.length("word").alias("n"))
    near = near.withColumn("starts", F.startswith("word", F.col("asked")))
    top = lambda df, k: df.withColumn("r", F.row_number().over(Window.partitionBy("asked").orderBy("n", "word"))).where(F.col("r") <= k)
    listed = lambda df, name: df.groupBy("asked").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]).alias(name))
    suggestions = top(near.where("starts").join(entries.select("asked"), "asked", "left_anti"), 3)
    hits = texts.select("text_id", "pos", F.explode(F.array_intersect("tokens", F.array(*map(F.lit, dict.fromkeys(words))))).alias("asked"))
    hits = checkpointed(hits)
    absent = asked.join(hits.select("asked").distinct(), "asked", "left_anti")
    if not absent.isEmpty():
        tokens = texts.select("text_id", "pos", F.explode(F.array_distinct("tokens")).alias("token"))
        inside = word_parts(tokens, absent.select(F.col("asked").alias("part")))
        hits = hits.union(tokens.join(inside, "token").select("text_id", "pos", F.col("part").alias("asked")).distinct())
    key = F.md5(F.concat_ws("|", "text_id", "pos"))
    one = hits.groupBy("asked", "text_id").agg(F.min(F.struct(key.alias("h"), "pos")).alias("m"))
    sample = one.withColumn("r", F.row_number().over(Window.partitionBy("asked").orderBy("m.h", "text_id"))).where(F.col("r") <= examples)
    sample = sample.groupBy("asked").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", F.concat_ws(":", "text_id", "m.pos").alias("at")))), lambda x: x["at"]).alias("examples"))
    if attributions is not None:
        named = F.struct(*attributions.columns)
        sources = entries.select("asked", F.explode(F.array_distinct(F.col("entries.source"))).alias("source"))
        known = sources.join(attributions, "source").groupBy("asked").agg(F.sort_array(F.collect_set(named)).alias("attributions"))
        entries = entries.join(known, "asked", "left")
    out = asked.join(entries, "asked", "left").join(listed(suggestions, "suggestions"), "asked", "left")
    return out.join(listed(top(near, related), "related"), "asked", "left").join(sample, "asked", "left")
