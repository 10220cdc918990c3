"""Ranked and fuzzy search, vocabularies and suggestions, for a list of queries at once.

Queries and terms are the caller's lists: they become literals of the plan, so no
table of unknown size is broadcast. Rankings end in a full tie-break, and their
top-k filters let Spark limit each group before the shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice
from sys import intern
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verseloom.functions.text import Kept, folded_tokens, tokens_of
from verseloom.operators.needles import needle_hits
from verseloom.operators.shared import checkpointed, request_table

MAX_QUERIES = 1_000  # queries of one call; more are asked in several calls
#: Scores depend on them.
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
RRF = 60

WORD = re.compile(r"[^\W_]+")
KEPT_WORDS = 50_000  # words whose trigrams a task keeps; a kept one takes about 1 KB
OUT_ROWS = 50_000  # rows of tokens that a task gives out at a time, about
BLOCK = 2_048  # vectors multiplied with the queries at a time


def _bounded(queries: list) -> list:
    if len(queries) > MAX_QUERIES:
        raise ValueError(f"at most {MAX_QUERIES} queries a call")
    return queries


def postings(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``token`` and the sorted ``positions`` of each folded token of each text."""
    tokens = docs.select("doc_id", F.posexplode(folded_tokens(F.col("text"))).alias("pos", "token"))
    return tokens.groupBy("doc_id", "token").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def _token_rows(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``token``, ``n``, ``first_pos``, ``last_pos``: once for each distinct token of each row, made where the row lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, columns = [], ([], [], [], [])
            for k, text in enumerate(batch.column(1)):
                tokens = tokens_of(text.as_py())
                counts = Counter(tokens)
                first = dict(zip(reversed(tokens), range(len(tokens) - 1, -1, -1)))
                last = dict(zip(tokens, range(len(tokens))))
                at.extend([k] * len(counts))
                for column, values in zip(columns, (counts, counts.values(), map(first.__getitem__, counts), map(last.__getitem__, counts))):
                    column.extend(values)
                if len(at) >= OUT_ROWS or k == batch.num_rows - 1:
                    made = [batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, pa.int64() if j else pa.string()) for j, c in enumerate(columns)]]
                    yield pa.RecordBatch.from_arrays(made, names=["doc_id", "token", "n", "first_pos", "last_pos"])
                    at, columns = [], ([], [], [], [])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, token string, n long, first_pos long, last_pos long")


def posting_sizes(docs: DataFrame) -> DataFrame:
    """How often, first and last where, each token stands in each text; only the tokens of texts that are several rows go through a shuffle."""
    several = docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc_id").alias("__id"))
    several = checkpointed(several)
    if several.isEmpty():
        return _token_rows(docs)
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    once, more = _token_rows(docs.join(several, same, "left_anti")), _token_rows(docs.join(several, same, "left_semi"))
    return once.union(more.groupBy("doc_id", "token").agg(F.sum("n"), F.min("first_pos"), F.max("last_pos")))


def vocabulary(docs: DataFrame) -> DataFrame:
    """Folded tokens with their number of texts and occurrences, counted by text first."""
    return posting_sizes(docs).groupBy("token").agg(F.count("*").alias("n_texts"), F.sum("n").cast("long").alias("n_total"))


def _top(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def prefix_suggestions(words: DataFrame, starts: list[str], k: int = 3) -> DataFrame:
    """For each start that is no word itself: words that begin with it, the shortest first."""
    mine = F.explode(F.filter(F.array(*map(F.lit, _bounded(starts))), lambda s: F.startswith("token", s))).alias("start")
    hits = words.select("token", mine)
    known = hits.where("token = start").select("start")
    return _top(hits.join(known, "start", "left_anti"), ["start"], [F.length("token"), "token"], k)


def word_parts(words: DataFrame, parts: list[str] | DataFrame) -> DataFrame:
    """``part`` and each ``token`` of ``words(token)`` that holds it, the part itself included; parts are a list or ``parts(part)`` of any size.

    The parts become one automaton a pass, which each distinct token runs through
    where it lies. Null and empty parts are in no token.
    """
    asked = request_table(words.sparkSession, parts, "part").where("part != ''")
    tokens = words.select("token").distinct()
    return needle_hits(tokens, {"token": F.col("token")}, asked.withColumnRenamed("part", "needle")).select(F.col("needle").alias("part"), "token")


def related_words(words: DataFrame, parts: list[str] | DataFrame, k: int = 10) -> DataFrame:
    """Other words that hold each part, the shortest first."""
    hits = word_parts(words, parts).where("token != part").select("token", "part")
    return _top(hits, ["part"], [F.length("token"), "token"], k)


def trigrams(word: Column) -> Column:
    """Distinct trigrams of a word behind two blanks and before one."""
    padded = F.concat(F.lit("  "), word, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substr(padded, i, F.lit(3))))


def fuzzy_words(words: DataFrame, terms: list[str], threshold: float = 0.3, k: int = 10) -> DataFrame:
    """Words whose trigrams overlap a term's (shared to all) at the threshold or above, the most alike first.

    Trigrams are joined by equality and counted; words that share none with a
    term never meet it.
    """
    asked = words.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(_bounded(terms))], "term string")
    asked = asked.select("term", trigrams(F.col("term")).alias("h")).select("term", F.size("h").alias("m"), F.explode("h").alias("g"))
    grams = words.select("token", trigrams(F.col("token")).alias("t")).select("token", F.size("t").alias("n"), F.explode("t").alias("g"))
    both = grams.join(F.broadcast(asked), "g").groupBy("term", "token").agg(F.count("*").alias("b"), F.first("n").alias("n"), F.first("m").alias("m"))
    scored = both.select("term", "token", F.round(F.col("b") / (F.col("n") + F.col("m") - F.col("b")), 4).alias("similarity"))
    return _top(scored.where(F.col("similarity") >= threshold), ["term"], [F.desc("similarity"), "token"], k)


def word_grams(word: str) -> list[str]:
    """Trigrams of a word behind two blanks and before one, in order."""
    padded = f"  {word} "
    return [padded[k : k + 3] for k in range(len(word) + 1)]


def extent_similarity(needle: set[str], grams: list[str], least: float = 0.0) -> float:
    """The largest share (common to all) of the needle's trigrams with those of any run of a text's trigrams; shares below ``least`` may come out smaller.

    A run that reaches a share has so many of the needle's trigrams and no more
    than size / share distinct ones: a start is passed over where the next place
    by which it has enough of the needle's lies behind too many others.
    """
    best, size = 0.0, len(needle)
    places = [k for k, g in enumerate(grams) if g in needle]
    need = max(1, math.ceil(least * size - 1e-9))
    window, enough, end = dict.fromkeys(needle, 0), 0, 0
    for low in places:
        while enough < need and end < len(places):
            g = grams[places[end]]
            enough += not window[g]
            window[g] += 1
            end += 1
        if enough < need:
            break
        high, widest = places[end - 1] + 1, size / max(best, least) if best or least else len(grams)
        window[grams[low]] -= 1
        enough -= not window[grams[low]]
        if high - low > widest and len(set(grams[low : min(high, low + int(4 * widest) + 1)])) > widest:
            continue
        seen, common = set(), 0
        for g in islice(grams, low, None):
            if g not in seen:
                seen.add(g)
                if g in needle:
                    common += 1
                    best = max(best, common / (size + len(seen) - common))
                elif max(best, least) * len(seen) > size:
                    break  # no longer run can be better
    return best


class FuzzyTerms:
    """Terms by their trigrams: which of them a text can be like, and how much."""

    def __init__(self, terms: list[str], threshold: float, counts: dict[str, int] | None = None) -> None:
        self.threshold, self.terms = threshold, []
        self.prefix: dict[str, list[int]] = {}
        for term in terms:
            grams = {g for w in WORD.findall(term.lower()) for g in word_grams(w)}
            if grams:
                need = math.ceil(threshold * len(grams) - 1e-9)
                rare = sorted(grams, key=lambda g: ((counts or {}).get(g, 0), g))
                # a text that holds fewer than ``need`` of the trigrams isn't like the term, so it holds one of these
                for g in rare[: len(grams) - max(need, 1) + 1]:
                    self.prefix.setdefault(g, []).append(len(self.terms))
                self.terms.append((term, grams, need))
        self.wanted = {g for _, grams, _ in self.terms for g in grams}
        self.grams = Kept(lambda word: tuple(map(intern, word_grams(word))), KEPT_WORDS)
        # most words have none of the trigrams: they share one empty tuple
        self.known = Kept(lambda word: tuple(intern(g) for g in word_grams(word) if g in self.wanted))

    def shared(self, words: list[str]) -> set[str]:
        """The wanted trigrams of a text's words."""
        return set(chain.from_iterable(map(self.known.__getitem__, set(words))))

    def alike(self, text: str | None) -> list[tuple[str, float, float]]:
        """``term``, similarity and word similarity of each term that a text in lower case is like."""
        words = WORD.findall(text or "")
        held = self.shared(words)
        near = {t for g in held if g in self.prefix for t in self.prefix[g]}
        found, grams = [], None
        for term, own, need in (self.terms[t] for t in near):
            if len(both := own & held) >= need:
                grams = list(chain.from_iterable(map(self.grams.__getitem__, words))) if grams is None else grams
                share = round(extent_similarity(own, grams, self.threshold - 1e-4), 4)
                if share >= self.threshold:
                    found.append((term, round(len(both) / (len(set(grams)) + len(own) - len(both)), 4), share))
        return found


def fuzzy_search(rows: DataFrame, terms: list[str], text: str = "segment", keys: tuple[str, ...] = ("doc_id", "pos"), threshold: float = 0.6, k: int = 10) -> DataFrame:
    """Rows with a part like each term: word similarity at the threshold or above, then similarity, the best ``k`` (1 to 50).

    A row can reach the threshold only if it shares so large a part of the term's
    trigrams, hence one of its rarest. The rows are counted once (how many hold
    each trigram of the terms) and read once more: a row is compared with the
    terms whose rarest trigrams it holds, and only what reaches the threshold
    leaves the task. No trigram of the corpus goes through a shuffle.
    """
    k = max(1, min(k, 50))
    asked = list(dict.fromkeys(_bounded(terms)))
    lowered = rows.select(*keys, F.lower(F.col(text)).alias("__text"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counts = FuzzyTerms(asked, threshold), Counter()
        for frame in frames:
            for value in frame["__text"]:
                counts.update(known.shared(WORD.findall(value or "")))
        yield pd.DataFrame({"g": list(counts), "n": list(counts.values())}).astype({"g": "object", "n": "int64"})

    grams = lowered.select("__text").mapInPandas(count, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))
    counts = {r["g"]: r["n"] for r in grams.collect()}  # the terms' own trigrams, no others

    @F.pandas_udf("array<struct<term string, similarity double, word_similarity double>>")
    def alike(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = FuzzyTerms(asked, threshold, counts)
        for texts in parts:
            yield pd.Series([[dict(zip(("term", "similarity", "word_similarity"), x)) for x in known.alike(t)] for t in texts], index=texts.index, dtype=object)

    scored = lowered.select(*keys, F.explode(alike("__text")).alias("x")).select("x.term", *keys, "x.similarity", "x.word_similarity")
    return _top(scored, ["term"], [F.desc("word_similarity"), F.desc("similarity"), *keys], k)


def bm25_search(docs: DataFrame, queries: list[str], k: int = 10) -> DataFrame:
    """Best texts for each query of folded words; a text holds all of them. Null and empty texts never do.

    Only tokens that some query names are exploded; the two corpus numbers are
    all that comes to the driver.
    """
    wanted = sorted({w for q in _bounded(queries) for w in q.split()})
    sized = docs.select("doc_id", folded_tokens(F.col("text")).alias("ts"))
    sized = sized.select("doc_id", "ts", F.size("ts").alias("dl"))
    n, mean = sized.agg(F.count("*"), F.avg("dl")).first()
    hits = sized.select("doc_id", "dl", F.explode(F.filter("ts", lambda t: t.isin(wanted))).alias("token"))
    tf = hits.groupBy("doc_id", "token").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean or 1.0)))
    asked = docs.sparkSession.createDataFrame(
        [(q, w, len(set(q.split()))) for q in queries for w in set(q.split())], "query string, token string, need int"
    )
    scored = tf.join(df, "token").select("doc_id", "token", part.alias("part")).join(asked, "token")
    found = scored.groupBy("query", "doc_id").agg(
        F.round(F.sum("part"), 4).alias("score"), F.count("*").alias("n"), F.first("need").alias("need")
    )
    found = found.where("n = need").select("query", "doc_id", "score")
    return _top(found, ["query"], [F.desc("score"), "doc_id"], k)


class Nearest:
    """The ``k`` nearest vectors to each of some queries, whatever the number of vectors added; ties go to the smallest id."""

    def __init__(self, ids: list[int], queries: np.ndarray, k: int) -> None:
        self.queries, self.unit, self.k = ids, queries.T, k
        self.away = np.full((len(ids), 0), np.inf)
        self.ids = np.zeros((len(ids), 0), dtype=np.int64)

    def add(self, ids: np.ndarray, block: np.ndarray) -> None:
        """One matrix product of a block of vectors with all queries; of each the best are chosen by partial selection, then merged with those held."""
        order = np.argsort(ids, kind="stable")
        ids, block = ids[order], block[order]
        away = np.round(1 - (block @ self.unit) / np.linalg.norm(block, axis=1)[:, None], 4).T
        if len(ids) > self.k:
            # distances have four digits: with the place by id they are one whole number, no two alike
            place = np.rint(away * 10_000).astype(np.int64) * len(ids) + np.arange(len(ids))
            near = np.argpartition(place, self.k - 1, axis=1)[:, : self.k]
        else:
            near = np.broadcast_to(np.arange(len(ids)), away.shape)
        away = np.concatenate((self.away, np.take_along_axis(away, near, axis=1)), axis=1)
        ids = np.concatenate((self.ids, ids[near]), axis=1)
        best = np.lexsort((ids, away), axis=1)[:, : self.k]
        self.away, self.ids = np.take_along_axis(away, best, axis=1), np.take_along_axis(ids, best, axis=1)

    def rows(self, limit: float) -> pd.DataFrame:
        chosen = self.away <= limit
        return pd.DataFrame({"query_id": np.repeat(self.queries, chosen.sum(axis=1)), "vec_id": self.ids[chosen], "distance": self.away[chosen]})


def nearest_of_tasks(vectors: DataFrame, known: list[tuple[int, np.ndarray]], k: int, limit: float) -> DataFrame:
    """``query_id``, ``vec_id``, ``distance``: at most ``k`` rows a query from each task, given out at its end."""
    groups = {d: [(i, v) for i, v in known if len(v) == d] for d in {len(v) for _, v in known}}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {d: Nearest([i for i, _ in group], np.stack([v for _, v in group]), k) for d, group in groups.items()}
        for frame in frames:
            lengths = frame["embedding"].map(len).to_numpy()
            for d in held.keys() & set(lengths.tolist()):
                part = frame[lengths == d]
                for low in range(0, len(part), BLOCK):
                    rows = part.iloc[low : low + BLOCK]
                    held[d].add(rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_list()).astype(float))
        for nearest in held.values():
            yield nearest.rows(limit)

    return vectors.select("vec_id", "embedding").mapInPandas(run, "query_id long, vec_id long, distance double")


def semantic_topk(vectors: DataFrame, query_ids: list[int], k: int = 10, limit: float = 1.0) -> DataFrame:
    """Vectors nearest to each query vector by cosine distance (double, four digits), ``limit`` or less.

    Each task keeps its own k best of a query and gives them out at its end; null,
    zero and non-finite vectors are skipped, and so are those of another length
    than the query's. Query vectors, at most ``MAX_QUERIES``, are read first.
    """
    rows = vectors.where(F.col("vec_id").isin(_bounded(query_ids)) & F.col("embedding").isNotNull()).collect()
    known = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in rows if None not in r["embedding"]]
    known = [(i, v / np.linalg.norm(v)) for i, v in known if np.isfinite(v).all() and v.any()]
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.where(whole & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull())
    return _top(nearest_of_tasks(usable, known, k, limit), ["query_id"], ["distance", "vec_id"], k)


def fuse(left: DataFrame, right: DataFrame, k: int = 10) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists ``query``, ``id``, ``rank``: an id of either list counts."""
    both = left.select("query", "id", F.col("rank").alias("l")).join(
        right.select("query", "id", F.col("rank").alias("r")), ["query", "id"], "full_outer"
    )
    part = lambda c: F.coalesce(1 / (RRF + F.col(c)), F.lit(0.0))
    return _top(both.select("query", "id", F.round(part("l") + part("r"), 4).alias("score")), ["query"], [F.desc("score"), "id"], k)


def hybrid_search(docs: DataFrame, vectors: DataFrame, queries: dict[str, int], leg: int = 50, k: int = 10) -> DataFrame:
    """Texts by fused rank of word search and of vector search; a query is words and the id of a vector, which several may share."""
    words = bm25_search(docs, list(queries), leg).select("query", F.col("doc_id").alias("id"), "rank")
    names = docs.sparkSession.createDataFrame(list(queries.items()), "query string, query_id long")
    near = semantic_topk(vectors, sorted(set(queries.values())), leg).join(F.broadcast(names), "query_id")
    return fuse(words, near.select("query", F.col("vec_id").alias("id"), "rank"), k)


class HashingEncoder:
    """Vectors of texts by hashed words: a stand-in for a model, alike on every machine."""

    def __init__(self, dims: int = 64) -> None:
        self.dims = dims

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = crc32(word.encode())
                row[h % self.dims] += 1 - 2 * (h >> 16 & 1)
        return out


def embed_corpus(texts: DataFrame, done: DataFrame, make_encoder=HashingEncoder, batch: int = 64) -> DataFrame:
    """``vec_id`` and ``embedding`` (float, length 1) of the ``texts(id, text)`` that have none in ``done(vec_id)`` yet.

    Each task makes one encoder and gives it ``batch`` texts at a time. Append
    the result to the vectors: a run that stops is taken up where it was. Blank
    texts get no vector; one that the encoder turns to zeros stays zero.
    """
    missing = texts.where(F.trim("text") != "").join(done.where("embedding is not null").select(F.col("vec_id").alias("id")), "id", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for frame in frames:
            for low in range(0, len(frame), batch):
                part = frame.iloc[low : low + batch]
                made = np.asarray(encode(part["text"].tolist()), dtype=np.float64)
                sizes = np.linalg.norm(made, axis=1, keepdims=True)
                made = (made / np.where(sizes > 0, sizes, 1)).astype(np.float32)
                yield pd.DataFrame({"vec_id": part["id"].to_numpy(), "embedding": list(made)})

    return missing.select("id", "text").mapInPandas(run, "vec_id long, embedding array<float>")


def phrase_search(postings: DataFrame, lengths: DataFrame, phrases: list[str], key: str = "doc_id", field: str | None = None, k: int = 10) -> DataFrame:
    """Best rows for each phrase of folded words that stand one behind the other, by BM25 of the phrase as one unit.

    ``postings(token, field, key, positions)`` as ``ingest.build_postings`` makes
    them, one ``field`` alone or all; ``lengths(key, size)`` has every row of the
    corpus. Only postings of the phrases' words are read from the join; two
    corpus numbers come to the driver.
    """
    spark = postings.sparkSession
    every = sorted({w for p in phrases for w in p.split()})
    postings = postings.where(F.col("token").isin(every))  # reaches the table's buckets, or the tokens before they are grouped
    asked = [(p, w, i, len(p.split())) for p in dict.fromkeys(_bounded(phrases)) for i, w in enumerate(p.split())]
    words = spark.createDataFrame(asked, "query string, token string, i int, need int")
    n, mean = lengths.agg(F.count("*"), F.avg("size")).first()
    chosen = postings if field is None else postings.where(F.col("field") == field)
    hits = chosen.join(F.broadcast(words), "token").select("query", "need", key, "field", "i", F.explode("positions").alias("at"))
    starts = hits.groupBy("query", key, "field", (F.col("at") - F.col("i")).alias("start")).agg(F.count("*").alias("c"), F.first("need").alias("need"))
    tf = starts.where("c = need").groupBy("query", key).agg(F.count("*").alias("tf"))
    df = tf.groupBy("query").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(mean or 1.0)))
    scored = tf.join(F.broadcast(df), "query").join(lengths, key).select("query", key, F.round(part, 4).alias("score"))
    return _top(scored, ["query"], [F.desc("score"), key], k)
