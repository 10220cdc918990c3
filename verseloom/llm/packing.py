"""Best-fit packing of tokenised documents into sequences under several capacities.

Every piece has a size in three resources: tokens, documents and attention cost
(the square of its length). A piece goes into the open sequence that has room in
all three and the largest weighted dot product of the piece with the room left
(or the smallest norm of what would be left). Pieces are dealt by hash into
groups of about ``GROUP`` and packed largest first, so a group wastes one or two
sequences of thousands, and no group grows with the input.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseloom.llm.common import Memo, checkpointed, serving
from verseloom.llm.token_counts import byte_letters

SEQUENCE = 4096
END = 1  # the id after each document
MAX_DOCS = 4096  # of a sequence; as many as it can hold tokens: no limit unless set lower
MAX_ATTENTION = SEQUENCE * SEQUENCE  # sum of squared lengths; likewise
WEIGHTS = (1.0, 0.1, 0.02)  # of tokens, documents and attention cost in the choice
GROUP = 20_000
KEPT = 400_000  # strings whose ids a worker keeps
SLICE = 500  # texts of an Arrow batch that are Python strings at a time


class Encoder:
    """Ids of texts as bytes, by a BPE tokenizer that never joins what a space or line feed separates.

    The texts of a slice are cut at spaces, and each new string is encoded once
    while it is kept. Strings of Latin letters, digits and signs are cut into
    words here and these merged by the library in one call a slice; others go
    through the whole tokenizer one by one.
    """

    def __init__(self, path: str, kept: int = KEPT) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark shares out the work
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merger = Tokenizer(self.tokenizer.model)
        self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        end = spec["model"]["end_of_word_suffix"]
        self.last = np.zeros(max(spec["model"]["vocab"].values()) + 1, dtype=bool)  # whether an id ends a word
        self.last[[i for t, i in spec["model"]["vocab"].items() if t.endswith(end)]] = True
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = byte_letters()
        self.strings = Memo(self._library, kept, owner="packing")
        self.others = Memo(self._library, kept // 8, owner="packing")

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _merge(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each of some words, as the pattern cuts them."""
        lettered = [w if w.isascii() else "".join([self.letters[b] for b in w.encode()]) for w in words]
        ids = np.array(self.merger.encode(" ".join(lettered), add_special_tokens=False).ids, dtype="<u4")
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        data = ids.tobytes()
        return {w: data[i:j] for w, i, j in zip(words, [0, *ends[:-1]], ends, strict=True)}

    def _learn(self, new: set[str]) -> None:
        """Keep the ids of lower-case strings."""
        marked = [t for t in new if t[-1:] in _MARKS and t[-2:-1].isalpha()]  # the tokenizer always cuts there
        new = new.difference(marked)
        new.update(x for t in marked for x in (t[:-1], t[-1]) if not self.strings.holds(x))
        cut = {t: [t] if t.isalpha() else self.pattern.findall(t) for t in new if _PLAIN.fullmatch(t)}
        ids = self._merge(list({w for words in cut.values() for w in words})) if cut else {}
        for text, words in cut.items():
            self.strings.put(text, ids[words[0]] if len(words) == 1 else b"".join(map(ids.__getitem__, words)))
        for text in new.difference(cut):
            self.strings.put(text, self._library(text))
        for text in marked:
            self.strings.put(text, self.strings[text[:-1]] + self.strings[text[-1]])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        plain, new = [], set()
        for text in texts:
            text, usual = text or "", True
            if "<|" in text or not text.isascii() and (_ODD.search(text) or not unicodedata.is_normalized("NFC", text)):
                usual = False
            else:
                text = text.lower()  # as the tokenizer will; equal strings then meet more often
            parts = text.replace("\n", " ").split(" ")
            if usual:
                new.update(parts)
            plain.append((parts, self.strings if usual else self.others))
        known, old = self.strings, self.strings.old
        if new := {t for t in new if t not in known and t not in old}:
            self._learn(new)
        return [b"".join(map(known.__getitem__, parts)) for parts, known in plain]


#: Where lower case depends on the neighbours or isn't composed.
_ODD = re.compile("[\u03a3\u0130]")
#: Signs, digits and Latin letters, whose kinds no version of Unicode changes.
_PLAIN = re.compile("[!-~\u00a1-\u024f]+")
_MARKS = frozenset(".,;:!?")


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, kept: int = KEPT) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if (path, kept) not in _encoders:
        _encoders[path, kept] = Encoder(path, kept)
    return _encoders[path, kept]


def pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE, kept: int = KEPT) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length`` and ``ids_crc32`` of the pieces of each row; ids stay in the task."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([END], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serving("packing")
        known = encoder(path, kept)
        for batch in batches:
            texts, rows = batch.column("text"), []
            for low in range(0, len(texts), SLICE):
                for k, ids in enumerate(known.encode(texts.slice(low, SLICE).to_pylist()), low):
                    ids += end
                    for p, at in enumerate(range(0, len(ids), 4 * sequence)):
                        part = ids[at : at + 4 * sequence]
                        rows.append((k, p, at // 4, len(part) // 4, crc32(part)))
            of, piece, start, length, crc = zip(*rows) if rows else ((),) * 5
            columns = [batch.column("doc_id").take(pa.array(of, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(
    lengths: list[int],
    sequence: int = SEQUENCE,
    max_docs: int = MAX_DOCS,
    max_attention: int = MAX_ATTENTION,
    weights: tuple[float, float, float] = WEIGHTS,
    by: str = "norm",
) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, the longest first.

    A piece is compared with the rooms of all open bins at once. ``by`` is "norm"
    (smallest weighted norm of the room left after) or "dot" (largest weighted
    dot product of the piece and the room before), both in shares of the
    capacities; ties go to the oldest bin. A bin without room for a token or a
    document is closed.
    """
    order = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    whole = np.array([[sequence], [max_docs], [max_attention]], dtype=np.float64)
    weight = np.array(weights, dtype=np.float64)[:, None]
    room, home, n, used = np.zeros((3, 1024)), np.zeros(1024, dtype=np.int64), 0, 0
    for k in order:
        size = np.array([[lengths[k]], [1], [min(lengths[k] ** 2, max_attention)]], dtype=np.float64)
        left = room[:, :used] - size
        fits = np.flatnonzero((left >= 0).all(axis=0))
        if len(fits):
            if by == "norm":
                share = left[:, fits] / whole
                at = int(fits[np.argmin((weight * share * share).sum(axis=0))])
            else:
                at = int(fits[np.argmax((weight * room[:, fits] / whole * (size / whole)).sum(axis=0))])
        else:
            if used == room.shape[1]:
                room = np.concatenate((room, np.zeros_like(room)), axis=1)
                home = np.concatenate((home, np.zeros_like(home)))
            at, room[:, used : used + 1], home[used] = used, whole, n
            used, n = used + 1, n + 1
        bins[k], offsets[k] = int(home[at]), sequence - int(room[0, at])
        room[:, at] -= size[:, 0]
        if room[0, at] < 1 or room[1, at] < 1:
            room[:, at : used - 1], home[at : used - 1] = room[:, at + 1 : used], home[at + 1 : used]
            used -= 1
    return bins, offsets


def _pack_groups(sequence: int, max_docs: int, max_attention: int, weights: tuple, by: str):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "ids_crc32", "doc_id", "piece"], ascending=False, kind="stable")
        bins, offsets = best_fit(frame["length"].tolist(), sequence, max_docs, max_attention, weights, by)
        first = int(frame["g"].iat[0]) << 32
        return frame.assign(sequence_id=np.array(bins, dtype=np.int64) + first, offset=np.array(offsets, dtype=np.int64))

    return run


def pack(
    docs: DataFrame,
    path: str,
    sequence: int = SEQUENCE,
    max_docs: int = MAX_DOCS,
    max_attention: int = MAX_ATTENTION,
    weights: tuple[float, float, float] = WEIGHTS,
    by: str = "norm",
    group: int = GROUP,
    kept: int = KEPT,
) -> DataFrame:
    """Pieces of all rows of ``docs`` with their ``sequence_id`` and ``offset``.

    Null and empty texts are one piece, the end id. Documents longer than a
    sequence are cut into full pieces and a rest; no other is. Repeated rows and
    null ids are packed like others; an empty table gives an empty result; other
    columns are not read.
    """
    found = checkpointed(pieces(docs, path, sequence, kept))
    groups = max(1, -(-found.count() // group))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = found.schema["doc_id"].dataType.simpleString()
    # rows that are equal in everything may stand in any group, so a number drawn from all columns deals them evenly
    # enough unless one row is repeated very often: its copies are dealt by their place in the written table
    dealt = found.withColumn(
        "g", F.pmod(F.xxhash64(*columns, F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(groups))
    )
    return (
        dealt.groupBy("g")
        .applyInPandas(
            lambda frame: _pack_groups(sequence, max_docs, max_attention, weights, by)(frame),
            f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, g long, sequence_id long, offset long",
        )
        .drop("g")
    )


def op9_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
