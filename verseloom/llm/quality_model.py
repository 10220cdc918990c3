"""Quality classifier from weak labels: overlapping heuristics, expectation-maximisation, a hashed linear scorer.

Heuristic labellers vote good, bad or nothing on each document. The counts of
their vote patterns over all documents are the exact input of an EM that
estimates each labeller's accuracy without gold labels. The posterior of a
pattern is the label of its documents; a linear scorer on hashed features is
fitted to these labels on a bounded sample and scores every document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseloom.llm.common import Memo, serving
from verseloom.llm.quality_rules import STOP_WORDS

FIT_ROWS = 6_000  # documents that the scorer is fitted on, by smallest hash of their id
BUCKETS = 1 << 14
THRESHOLD = 0.5
WINDOW, RUN = 400, 5  # words that distinct ones are counted in; words of a run that a repeated passage repeats
SHORT = 40  # words below which a document is short
ABSTAIN, BAD, GOOD = 0, 1, 2
LABELLERS = ("symbols", "stop words", "capitals", "separators", "distinct words", "word length", "sentence ends", "repeats")

_stop = frozenset(STOP_WORDS)


def _vote(value: float, good: tuple[float, float], bad_below: float, bad_above: float) -> int:
    if value < bad_below or value > bad_above:
        return BAD
    return GOOD if good[0] <= value <= good[1] else ABSTAIN


def _distinct(words: list[str]) -> float:
    """Share of distinct words, in a long text averaged over windows, times the share of its runs of words that are new."""
    n = len(words)
    if n <= WINDOW:
        return len(set(words)) / max(1, n)
    windows = [words[min(k, n - WINDOW) :][:WINDOW] for k in range(0, n, WINDOW)]
    runs = set(zip(*(words[k:] for k in range(RUN))))
    return sum(len(set(w)) for w in windows) / (WINDOW * len(windows)) * len(runs) / (n - RUN + 1)


def _repeats(words: list[str]) -> float:
    """Share of words that equal the word before."""
    return sum(map(eq, words, words[1:])) / max(1, len(words))


def votes(text: str | None) -> tuple[int, ...]:
    """One vote of each labeller; a text without words gets no votes but one bad one."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return (ABSTAIN, BAD) + (ABSTAIN,) * (len(LABELLERS) - 2)
    chars = sum(map(len, words))
    share = lambda x: x / n
    return (
        _vote(share(sum(map(text.count, "#*$%&<>"))), (0, 0.02), -1, 0.1),
        _vote(share(sum(map(_stop.__contains__, words))), (0.12, 0.6), 0.05, 0.7) if n >= 20 else ABSTAIN,
        _vote(share(sum(map(str.isupper, words))), (0, 0.1), -1, 0.3),
        _vote(share(text.count(" | ") + text.count("!!")), (0, 0.01), -1, 0.1),
        _vote(_distinct(words), (0.5, 1), 0.25, 1) if n >= 30 else ABSTAIN,
        _vote(chars / n, (4.3, 6), 3, 9) if n >= 10 else ABSTAIN,
        _vote(share(text.count(".") + text.count("?") + text.count("!")), (0.02, 0.25), 0.005, 0.5) if n >= 20 else ABSTAIN,
        _vote(_repeats(words), (0, 0.03), -1, 0.15),
    )


def vote_code(text: str | None) -> int:
    """The votes as one number, and whether the text is short."""
    short = len((text or "").split(None, SHORT)) < SHORT
    return sum(v * 3**k for k, v in enumerate((*votes(text), int(short))))


def fit_labellers(
    patterns: np.ndarray, short: np.ndarray, counts: np.ndarray, rounds: int = 200
) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns (rows of votes) with their counts: posteriors, tables P(vote | class), prior of good.

    Not to vote is a vote of its own, but for short documents, on which few labellers can vote.
    """
    k = patterns.shape[1]
    good = (patterns == GOOD).sum(1) - 2.0 * (patterns == BAD).sum(1)
    post = 1 / (1 + np.exp(-good))
    hot = np.stack([patterns == v for v in (ABSTAIN, BAD, GOOD)], axis=2).astype(float)  # pattern, labeller, vote
    hot[short, :, 0] = 0
    table = np.zeros((2, k, 3))
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts])
        table = np.einsum("cp,pkv->ckv", weight, hot) + 1
        table /= table.sum(2, keepdims=True)
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        logs = np.einsum("ckv,pkv->cp", np.log(table), hot) + np.log([[1 - prior], [prior]])
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        moved, post = np.abs(new - post).max(), new
        if moved < 1e-9:
            break
    return post, table, float(prior)


_letters, _digits, _marks = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"([^\w\s])\1+")


def _case(word: str) -> str:
    return "A" if len(word) > 1 and word.isupper() else "Aa" if word[0].isupper() else "a"


def _shape(word: str) -> int:
    """Bucket of a word's shape: runs of letters by their case, digits as one, marks as they are."""
    core = word.rstrip(".,;:!?*#$%&|")
    if core.isalpha():
        word = _case(core) + _marks.sub(r"\1+", word[len(core) :])
    else:
        word = _marks.sub(r"\1+", _digits.sub("0", _letters.sub(lambda m: _case(m[0]), word)))
    return crc32(b"s" + word[:16].encode()) % BUCKETS


_shapes = Memo(_shape, 100_000, owner="quality model")


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: the share of each word's shape, and which part of its range some ratios fall into."""
    words = text.split()
    n = max(1, len(words))
    parts = {
        "stop": int(20 * sum(map(_stop.__contains__, words)) / n),
        "distinct": int(10 * _distinct(words)),
        "repeats": int(20 * _repeats(words)),
        "words": min(6, int(math.log2(n))),
        "length": min(20, int(2 * sum(map(len, words)) / n)),
    }
    more = [crc32(f"{k}={v}".encode()) % BUCKETS for k, v in parts.items()]
    at = np.fromiter(map(_shapes.__getitem__, words), np.int64, len(words))
    return np.concatenate((at, more)), np.concatenate((np.full(len(at), 4 / n), np.full(len(more), 0.5)))


def compact(at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same features with one value for each bucket."""
    buckets, back = np.unique(at, return_inverse=True)
    return buckets, np.bincount(back, value)


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic regression of the targets (0 to 1) on hashed features; the last weight is the bias."""
    weights = np.zeros(BUCKETS + 1)
    if not rows:
        return weights
    doc = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    at, value = np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows])
    # each class has the same weight
    balance = np.where(target > 0.5, 0.5 / max(1e-9, (target > 0.5).mean()), 0.5 / max(1e-9, (target <= 0.5).mean()))
    m, s = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, rounds + 1):
        z = np.bincount(doc, weights[at] * value, len(rows)) + weights[-1]
        error = (1 / (1 + np.exp(-z)) - target) * balance / len(rows)
        grad = np.append(np.bincount(at, error[doc] * value, BUCKETS), error.sum()) + 1e-5 * weights
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        weights -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
    return weights


def score_text(text: str | None, weights: np.ndarray) -> float:
    if not text or not text.strip():
        return 0.0
    at, value = features(text)
    return float(1 / (1 + math.exp(-max(-500.0, min(500.0, float((weights[at] * value).sum() + weights[-1]))))))


def _pattern_column(text):
    @F.pandas_udf("long")
    def pattern(texts: pd.Series) -> pd.Series:
        serving("quality model")
        return pd.Series([vote_code(t) for t in texts], dtype="int64")

    return pattern(text)


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Weights of the scorer. To the driver come the counts of vote patterns (2 * 3**8 at most) and ``fit_rows`` rows of features."""
    marked = docs.select("doc_id", "text").where("text is not null")
    found = marked.groupBy(_pattern_column(F.col("text")).alias("p")).count().collect()
    if not found:
        return np.zeros(BUCKETS + 1)
    codes = np.array([r["p"] for r in found])
    patterns = np.stack([codes // 3**k % 3 for k in range(len(LABELLERS))], axis=1)
    post, _, _ = fit_labellers(patterns, codes // 3 ** len(LABELLERS) > 0, np.array([r["count"] for r in found], dtype=float))
    label = dict(zip(codes.tolist(), post.tolist()))
    ids = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [(vote_code(t), *map(list, compact(*features(t)))) for t in frame["text"]]
            yield pd.DataFrame(got, columns=["p", "at", "value"])

    sample = marked.join(F.broadcast(ids.distinct()), "doc_id").select("text").mapInPandas(
        rows, "p long, at array<long>, value array<double>"
    )
    sample = [r for r in sample.limit(fit_rows).collect() if r["p"] in label]
    return fit_scorer(
        [(np.array(r["at"], dtype=np.int64), np.array(r["value"])) for r in sample],
        np.array([label[r["p"]] for r in sample]),
    )


def score_column(text, weights: np.ndarray):
    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        serving("quality model")
        return pd.Series([score_text(t, weights) for t in texts], dtype="float64")

    return scores(text)


def classify(docs: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1, higher is better) and ``kept`` of every row of ``docs``.

    Fitted on ``docs`` itself, without gold labels. Null, empty and blank texts
    score 0; repeated rows and null ids stay; an empty table gives an empty
    result; columns other than ``doc_id`` and ``text`` are not read.
    """
    weights = fit(docs, fit_rows)
    scored = docs.select("doc_id", score_column(F.col("text"), weights).alias("score"))
    return scored.withColumn("kept", F.col("score") >= threshold)


def filter_documents(docs: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns, whatever the names.

    Null, empty and blank texts are scored like others; a repeated row stays as
    often as it stands, with one score; an empty table stays empty.
    """
    weights = fit(docs, fit_rows)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return whole.where(score_column(F.col("row.text"), weights) >= threshold).select("row.*")


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
