"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseloom.llm.common import Memo

MAX_TOKENS = 2048


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + k)
    return [letters[b] for b in range(256)]


def merged_size(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges: the lowest-rank pair first, the leftmost of equals."""
    n = len(symbols)
    if n < 2:
        return n
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    if not heap:
        return n
    heapq.heapify(heap)
    symbols, after, before, left = symbols[:], list(range(1, n + 1)), list(range(-1, n - 1)), n
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if j >= n or symbols[i] is None or ranks.get((symbols[i], symbols[j])) != rank:
            continue  # one of the two has been merged meanwhile
        symbols[i] += symbols[j]
        symbols[j] = None
        left -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return left


class WordCounter:
    """Tokens of texts by one vocabulary file; counts of strings and of words are kept."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.ranks = {tuple(m): k for k, m in enumerate(spec["model"]["merges"])}
        self.end = spec["model"]["end_of_word_suffix"] or ""
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = byte_letters()
        self.words = Memo(self._word)
        self.strings = Memo(self._string)

    def _word(self, word: str) -> int:
        symbols = [self.letters[b] for b in word.encode()]
        symbols[-1] += self.end
        return merged_size(symbols, self.ranks)

    def _plain(self, text: str) -> int:
        text = unicodedata.normalize("NFC", text)
        # letter by letter: a capital sigma at the end of a word is no exception
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        return sum(map(self.words.__getitem__, self.pattern.findall(text)))

    def _string(self, text: str) -> int:
        """Of a string without spaces or line feeds, special tokens in it included."""
        specials = len(self.special.findall(text)) if "<" in text else 0
        return specials + sum(map(self._plain, self.special.split(text) if specials else [text]))

    def tokens(self, text: str | None) -> int:
        return sum(map(self.strings.__getitem__, text.replace("\n", " ").split(" "))) if text else 0


_counters: dict[str, WordCounter] = {}


def counter(path: str) -> WordCounter:
    """This worker's counter for a vocabulary file."""
    if path not in _counters:
        _counters[path] = WordCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of each row of ``docs``.

    ``path`` is a vocabulary file that all executors have. Null texts count as
    empty ones: 0 bytes, 0 tokens. Texts are counted whole, strings without
    white space too; repeated rows and null ids stay; other columns are not read.
    """

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = counter(path)
        for texts in parts:
            yield pd.Series([known.tokens(t) for t in texts], dtype="int64")

    n = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        count("text").alias("n_tokens"),
    )
    return n.withColumn("over_limit", F.col("n_tokens") > max_tokens)


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")
    )
