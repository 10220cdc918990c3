"""Toxicity: a linear-chain conditional random field that tags toxic tokens.

Only documents are labelled, and a document's label binds the tags of its tokens:
no token of a clean document is toxic, at least one of a toxic document is, but
for a share of wrong labels, which is fitted too. The field has two tags,
transition weights and one weight a feature: the word, its beginnings, its form,
and the words before and after it. It is fitted by gradient steps on the
likelihood of these bound tags over whole texts. Forward-backward marginals give
the offending offsets, and 1 - prod(1 - marginal) over the tokens with features
the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseloom.llm.common import Memo, checkpointed

# Bounds on the labelled rows that a fit uses; scoring has none.
FIT_ROWS = 10_000  # labelled documents of each class whose features are counted, by smallest hash of their id
FIELD_ROWS = 1_000  # of these, documents of each class, with their whole texts, that the weights are fitted on
EVIDENCE = 2.0  # a feature more frequent in toxic documents has a weight if its log-likelihood ratio is this many times the log of the features tried
CHUNK = 32  # words of a chain in the fit; a longer text is several chains
PENALTY = 0.02  # of squared weights, in documents
MISSED = 2.0  # what a toxic document counts beside a clean one in the fit
SPAN_AT = 0.5
WORDS = 200_000  # whose marginals are found together, whole texts

_word = re.compile(r"[^\W\d_]+")


def _own(word: str) -> list[str]:
    low = word.lower()
    form = ["f:caps"] if len(word) > 2 and word.isupper() else []
    return [f"w:{low}", *(f"b:{low[:k]}" for k in (4, 5, 6) if len(low) > k), *form]


def token_features(word: str, before: str = "", after: str = "") -> list[str]:
    """Names of the features of a token between two others ("": the text's edge)."""
    return [*_own(word), f"p:{before.lower()}", f"n:{after.lower()}"]


@dataclass
class Model:
    """Weights of the toxic tag relative to the other: per feature, bias, and ``moves[from][to]``."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    moves: tuple = ((0.0, 0.0), (0.0, 0.0))

    def __post_init__(self) -> None:
        get = self.weights.get
        self.memo = Memo(lambda w: sum(get(f, 0.0) for f in _own(w)))
        self.beside = Memo(lambda w: complex(get("p:" + w.lower(), 0.0), get("n:" + w.lower(), 0.0)))
        self.neighbours = any(f[0] in "pn" for f in self.weights)
        self.base = np.exp(np.array(self.moves) + np.array([0.0, self.bias]))

    def __reduce__(self):
        return Model, (self.weights, self.bias, self.moves)

    def tagged(self, texts: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text's words: positions of those with features, and how likely each is toxic; exact over the whole text."""
        lengths = np.array([len(x) for x in texts], dtype=np.int64)
        n = int(lengths.sum())
        if not n:
            return [(np.empty(0, dtype=np.int64), np.empty(0))] * len(texts)
        words = [""]  # a text's edge before, between and after the texts
        for text in texts:
            words += text
            words.append("")
        extra = np.fromiter(map(self.memo.__getitem__, words), float, len(words))
        if self.neighbours:
            beside = np.fromiter(map(self.beside.__getitem__, words), complex, len(words))
            extra[1:] += beside.real[:-1]
            extra[:-1] += beside.imag[1:]
        ends = np.cumsum(lengths)
        inside = np.ones(len(words), dtype=bool)
        inside[np.concatenate(([0], ends + np.arange(1, len(texts) + 1)))] = False
        extra = extra[inside]
        lift = np.exp(np.clip(extra, -30, 30))
        ahead = np.repeat(self.base.reshape(4, 1), n, axis=1)
        ahead[1::2] *= lift
        back = np.ones((4, n))  # at a text's last word nothing follows
        back[:, :-1] = ahead[[0, 2, 1, 3], 1:]
        full = ends[lengths > 0]
        back[:, full - 1] = 1.0
        first = full - lengths[lengths > 0]
        ahead[2:, first] = ahead[:2, first]  # before a text: the other tag, whatever the text before it ended with
        both = running(ahead) * running(back[:, ::-1])[:, ::-1]
        p = both[1] / both.sum(axis=0)
        out = []
        for start, end in zip((ends - lengths).tolist(), ends.tolist()):
            at = np.flatnonzero(extra[start:end])
            out.append((at, p[start:end][at]))
        return out

    def marginals(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``tagged`` of one text."""
        return self.tagged([words])[0]

    def score(self, text: str | None) -> float:
        """0 to 1; 0 for null and empty texts and for those without features."""
        return _any(self.marginals(_word.findall(text or ""))[1])

    def spans(self, text: str | None) -> list[tuple[int, int]]:
        """Start and end of the toxic runs of a text, in characters."""
        return _runs(text or "", *self.marginals(_word.findall(text or "")))


def running(m: np.ndarray) -> np.ndarray:
    """The row vectors (1, 0) m[0] ... m[t] for each t, scaled to a sum of 1.

    ``m`` holds the entries 00, 01, 10 and 11 of the matrices, one column each. They
    are cut into about as many blocks as a block has places, and a step takes one
    place of all blocks: first for the blocks' products, then for the vectors.
    """
    n = m.shape[1]
    size = max(1, math.isqrt(n))
    blocks = -(-n // size)
    padded = np.repeat(np.array([[1.0], [0.0], [0.0], [1.0]]), blocks * size, axis=1)
    padded[:, :n] = m
    steps = np.ascontiguousarray(padded.reshape(4, blocks, size).transpose(2, 0, 1))
    a, b, c, d = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for k, (e, f, g, h) in enumerate(steps):
        a, b, c, d = a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h
        if k % 8 == 7:  # a factor of a step is at most e^30 or so
            scale = a + b + c + d
            a, b, c, d = a / scale, b / scale, c / scale, d / scale
    starts = np.empty((2, blocks))
    x, y = 1.0, 0.0
    for k, (p, q, r, s) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())):
        starts[:, k] = x, y
        x, y = x * p + y * r, x * q + y * s
        x, y = x / (x + y), y / (x + y)
    out = np.empty((size, 2, blocks))
    x, y = starts
    for k, (e, f, g, h) in enumerate(steps):
        x, y = x * e + y * g, x * f + y * h
        scale = x + y
        x, y = x / scale, y / scale
        out[k, 0], out[k, 1] = x, y
    return out.transpose(1, 2, 0).reshape(2, -1)[:, :n]


def _any(p: np.ndarray) -> float:
    """How likely one token at least is toxic."""
    return float(1 - np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0


def _runs(text: str, at: np.ndarray, p: np.ndarray) -> list[tuple[int, int]]:
    toxic = set(at[p >= SPAN_AT].tolist())
    out: list[tuple[int, int]] = []
    last = -2
    for k, found in enumerate(_word.finditer(text) if toxic else ()):
        if k in toxic:
            start, end = found.span()
            if k == last + 1:
                start = out.pop()[0]
            out.append((start, end))
            last = k
    return out


def _together(texts) -> Iterator[tuple[list[str], list[list[str]]]]:
    """Texts and their words, about ``WORDS`` words at a time."""
    some: list[str] = []
    words: list[list[str]] = []
    n = 0
    for text in texts:
        some.append(text or "")
        words.append(_word.findall(text or ""))
        n += len(words[-1])
        if n >= WORDS:
            yield some, words
            some, words, n = [], [], 0
    if some:
        yield some, words


class Chains:
    """Labelled texts as chains of ``CHUNK`` words at most, equal ones once, for ``objective``.

    ``texts`` holds for each text its label, its number of words, the positions
    of words with features, and these words' lists of feature numbers.
    """

    def __init__(self, texts: list[tuple], n_features: int) -> None:
        known: dict[tuple, int] = {}
        doc, chain, times = [], [], []
        for d, (_, n, at, ids) in enumerate(texts):
            found: dict[int, list] = {}
            for k, i in zip(at, ids):
                found.setdefault(k // CHUNK, []).append((k % CHUNK, tuple(i)))
            length = lambda c: min(CHUNK, n - c * CHUNK)
            here = Counter((length(c), tuple(x)) for c, x in found.items())
            last = (n - 1) // CHUNK
            plain = last + 1 - len(found)
            if plain and last not in found:
                here[(length(last), ())] += 1
                plain -= 1
            if plain:
                here[(CHUNK, ())] += plain
            for key, c in here.items():
                doc.append(d)
                chain.append(known.setdefault(key, len(known)))
                times.append(c)
        self.n, self.n_docs, self.n_features = len(known), len(texts), n_features
        self.doc, self.chain, self.times = np.array(doc), np.array(chain), np.array(times, float)
        self.lengths = np.array([k[0] for k in known])
        pairs = [(u * CHUNK + at, i) for (_, marks), u in known.items() for at, ids in marks for i in ids]
        self.token, self.feat = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
        self.toxic = np.array([t[0] for t in texts]) == 1
        self.there = np.arange(CHUNK) < self.lengths[:, None]


def objective(theta: np.ndarray, data: Chains, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood of the labels, each with its weight, and its gradient.

    ``theta``: features, bias, four moves, and the log-odds of a wrong label. A
    text is labelled clean if no tag is toxic and its label isn't wrong.
    """
    n, k = data.n, data.n_features
    moves, wrong = theta[k + 1 : k + 5].reshape(2, 2), 1 / (1 + np.exp(-theta[k + 5]))
    emit = (np.bincount(data.token, theta[data.feat], n * CHUNK) + theta[k]).reshape(n, CHUNK)
    there = data.there
    a = np.empty((CHUNK, n, 2))
    start = np.broadcast_to(np.array([0.0, -np.inf]), (n, 2))
    previous = start
    for j in range(CHUNK):
        now = np.logaddexp(previous[:, 0, None] + moves[0], previous[:, 1, None] + moves[1])
        now[:, 1] += emit[:, j]
        a[j] = previous = np.where(there[:, j, None], now, previous)
    z = np.logaddexp(previous[:, 0], previous[:, 1])
    none = np.bincount(data.doc, data.times * (data.lengths * moves[0, 0] - z)[data.chain], data.n_docs) + np.log1p(-wrong)
    none = np.minimum(none, -1e-9)
    value = float((weight * np.where(data.toxic, np.log(-np.expm1(none)), none)).sum())
    # how the value moves with the log of each text's chance to have no toxic tag
    push = weight * np.where(data.toxic, -np.exp(none) / -np.expm1(none), 1.0)
    per_chain = np.bincount(data.chain, data.times * push[data.doc], n)
    p1, expected = np.zeros((n, CHUNK)), np.zeros((2, 2))
    b = np.zeros((n, 2))
    for j in range(CHUNK - 1, -1, -1):
        p1[:, j] = np.exp(a[j, :, 1] + b[:, 1] - z)
        step = b.copy()
        step[:, 1] += emit[:, j]
        ahead = a[j - 1] if j else start
        scale = np.where(there[:, j], per_chain, 0.0)
        for x in (0, 1):
            for y in (0, 1):
                expected[x, y] += (scale * np.exp(ahead[:, x] + moves[x, y] + step[:, y] - z)).sum()
        back = np.logaddexp(moves[:, 0] + step[:, :1], moves[:, 1] + step[:, 1:])
        b = np.where(there[:, j, None], back, b)
    p1 *= there * per_chain[:, None]
    grad = np.zeros(k + 6)
    grad[:k] = -np.bincount(data.feat, p1.ravel()[data.token], k)
    grad[k] = -p1.sum()
    grad[k + 1 : k + 5] = -expected.ravel()
    grad[k + 1] += (per_chain * data.lengths).sum()
    grad[k + 5] = -wrong * push.sum()
    return value, grad


def fit_field(data: Chains, weight: np.ndarray, rounds: int = 120) -> tuple[np.ndarray, float, tuple]:
    """Weights by penalised maximum likelihood: features, bias, moves."""
    k = data.n_features
    theta = np.zeros(k + 6)
    theta[k], theta[k + 5] = Model.bias, -3.0
    theta[:k] = 4.0  # features were chosen as they tell toxic documents
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    keep = np.concatenate((np.ones(k), [0.01], np.full(4, 10.0), [0.01]))  # moves near 0: a span ends unless its words go on
    for t in range(1, rounds + 1):
        _, grad = objective(theta, data, weight)
        grad = (grad - PENALTY * keep * theta) / weight.sum()
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        theta += 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
    return theta[:k], float(theta[k]), tuple(map(tuple, theta[k + 1 : k + 5].reshape(2, 2).tolist()))


def _evidence(t, c, n_toxic: int, n_clean: int):
    """Log-likelihood ratio of a feature's documents in both classes against equal shares."""
    both = (t + c) / (n_toxic + n_clean)
    part = lambda k, n: k * F.log(F.greatest(k, F.lit(1)) / n / both) + F.when(k < n, (n - k) * F.log((n - k) / n / (1 - both))).otherwise(0)
    return 2 * (part(t, n_toxic) + part(c, n_clean))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, field_rows: int = FIELD_ROWS) -> Model:
    """A model of ``labels.toxic`` from at most ``fit_rows`` labelled documents of each class.

    A document whose label rows differ counts as toxic. Rows without id, text or
    label are not used, nor other columns; a repeated row counts as often as it
    stands; ties of the hash go by id. Empty tables, and labels of one class
    alone, give a model without features, which scores 0. To the driver come the
    features with ``EVIDENCE`` and of twice ``field_rows`` documents the places of these.
    """
    gold = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    chosen = [gold.where(F.col("toxic") == k).orderBy(*order).limit(fit_rows) for k in (1, 0)]
    texts = docs.where("text is not null").select("doc_id", "text")
    rows = texts.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").select("text", "toxic")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = (Counter(), Counter())
        docs_seen = Counter()
        for frame in frames:
            for text, toxic in zip(frame["text"], frame["toxic"]):
                docs_seen[int(toxic)] += 1
                words = _word.findall(text)
                low = ["", *map(str.lower, words), ""]
                found = {f for w in set(words) for f in _own(w)}
                found.update("p:" + w for w in set(low[: len(words)]))
                found.update("n:" + w for w in set(low[2:]))
                seen[int(toxic)].update(found)
        kinds = {"f": "object", "t": "int64", "c": "int64"}  # a task without rows has no values to tell them by
        for toxic, column in ((1, "t"), (0, "c")):
            names = list(seen[toxic])
            for k in range(0, len(names), 50_000):
                part = names[k : k + 50_000]
                got = pd.DataFrame({"f": part, "t": 0, "c": 0}).astype(kinds)
                got[column] = [seen[toxic][f] for f in part]
                yield got
        if docs_seen:
            yield pd.DataFrame({"f": [""], "t": [docs_seen[1]], "c": [docs_seen[0]]}).astype(kinds)

    counts = rows.mapInPandas(count, "f string, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counts = checkpointed(counts.where("t >= 2 or f = ''"))
    totals = counts.where("f = ''").first()
    if totals is None or not totals["t"] or not totals["c"]:
        return Model()
    n_toxic, n_clean = totals["t"], totals["c"]
    t, c = F.col("t"), F.col("c")
    telling = (t * n_clean > c * n_toxic) & (_evidence(t, c, n_toxic, n_clean) >= EVIDENCE * np.log(counts.count()))
    names = sorted(r["f"] for r in counts.where((F.col("f") != "") & telling).select("f").collect())
    if not names:
        return Model()
    number = {f: k for k, f in enumerate(names)}

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = []
            for text, toxic in zip(frame["text"], frame["toxic"]):
                words = _word.findall(text)
                around = zip(words, ["", *words], [*words[1:], ""])
                marked = [[number[f] for f in token_features(*x) if f in number] for x in around]
                at = [k for k, x in enumerate(marked) if x]
                got.append((int(toxic), len(words), at, [marked[k] for k in at]))
            if got:
                yield pd.DataFrame(got, columns=["toxic", "n", "at", "ids"])

    few = [c.limit(field_rows) for c in chosen]
    sample = texts.join(F.broadcast(few[0].union(few[1])), "doc_id").select("text", "toxic")
    sample = sample.mapInPandas(places, "toxic int, n int, at array<int>, ids array<array<int>>").where("n > 0").collect()
    if not sample:
        return Model()
    data = Chains(sorted(map(tuple, sample)), len(names))
    # the classes weigh as they stand in the labels, a toxic document more
    known = {r["toxic"]: r["count"] for r in gold.groupBy("toxic").count().collect()}
    share = [known.get(x, 0) / max(1, int((data.toxic == x).sum())) for x in (0, 1)]
    weight = np.where(data.toxic, MISSED * share[1], share[0])
    weights, bias, moves = fit_field(data, weight * len(weight) / weight.sum())
    return Model(dict(zip(names, weights.tolist())), bias, moves)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` (1 from 0.5 on) and ``spans`` (offsets in characters) of each row.

    Null and empty texts and those without any feature score 0 and have no
    spans; repeated rows and null ids stay; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for frame in frames:
            scores, spans = [], []
            for texts, words in _together(frame["text"]):
                for text, (at, p) in zip(texts, known.tagged(words)):
                    scores.append(_any(p))
                    found = _runs(text, at, p) if scores[-1] >= SPAN_AT else []
                    spans.append([{"start": a, "end": b} for a, b in found])
            yield pd.DataFrame(
                {"doc_id": frame["doc_id"], "score": scores, "predicted": [int(s >= 0.5) for s in scores], "spans": spans}
            )

    return docs.select("doc_id", "text").mapInPandas(
        run, f"doc_id {kind}, score double, predicted int, spans array<struct<start:int,end:int>>"
    )


def held_out(doc_id):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.where(~held_out("doc_id")))
    scored = score(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "spans")
