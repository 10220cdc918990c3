"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

A sequence of tokens is the encoding of its bytes exactly if each token encodes
to itself and each two neighbours do as a pair. So every prefix of a piece has
one last token, and the only prefixes that still matter are those at which a
longer token may start. A transducer state is the set of these: for each, the
bytes since then and the last token before. A transition says which of them go
on and on which of them the new prefix's last token stands. Tokens go out when
one prefix alone is left, a longest token later at most. States and transitions
are made when first met, and kept.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from verseloom.llm.common import Memo

STATES = 200_000  # states kept by a task before it starts anew


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


class State:
    """``live``: (bytes since, last token before or -1) of each prefix that still matters, the longest bytes first."""

    __slots__ = ("live", "next")

    def __init__(self, live: tuple) -> None:
        self.live, self.next = live, {}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes = {r: t for t, r in ranks.items()}
        self.prefixes = {t[:k] for t in ranks for k in range(1, len(t))}
        self.halves = Memo(self._halves, 1 << 20)
        self.pairs = Memo(self._pair, 500_000)
        self._anew()

    def _anew(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self._state(((b"", -1),))

    def _state(self, live: tuple) -> State:
        state = self.states.get(live)
        if state is None:
            state = self.states[live] = State(live)
        return state

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token; None for a byte."""
        data = self.bytes[token]
        if len(data) == 1:
            return None
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 2:
            ranked = [(r, k) for k in range(len(parts) - 1) if (r := self.ranks.get(parts[k] + parts[k + 1])) is not None]
            rank, k = min(ranked, default=(token, 0))
            if rank >= token:
                raise ValueError(f"no merges make the token {token}")
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _pair(self, pair: tuple[int, int]) -> bool:
        """Whether a token can follow another; -1 is the start of a piece.

        Undo the later merge of the two sides again and again: no merge across
        the boundary may come before the one that is undone next.
        """
        a, b = pair
        try:
            right, left = self.halves[b], a >= 0 and self.halves[a]
        except ValueError:
            return False
        if a < 0:
            return True
        ranks, whole, bound = self.ranks, self.bytes, 1 << 62
        while True:
            across = ranks.get(whole[a] + whole[b])
            if across is not None and across < bound:
                return False
            left, right = self.halves[a], self.halves[b]
            if left is not None and (right is None or a > b):
                bound, a = a, left[1]
            elif right is not None:
                bound, b = b + 1, right[0]
            else:
                return True

    def step(self, state: State, byte: int) -> tuple[State, list[int], int, int]:
        """The next state, the prefixes that go on, the one that the new token stands on, the token."""
        live, on, base, end, add = [], [], -1, -1, bytes((byte,))
        for k, (since, last) in enumerate(state.live):
            word = since + add
            if base < 0 and (token := self.ranks.get(word)) is not None and self.pairs[(last, token)]:
                base, end = k, token
            if word in self.prefixes:
                live.append((word, last))
                on.append(k)
        if base < 0:
            raise ValueError("the ranks lack a byte")
        live.append((b"", end))
        return self._state(tuple(live)), on, base, end

    def encode(self, data: bytes) -> list[int]:
        """Tokens of one piece."""
        if len(self.states) > STATES:
            self._anew()
        state, chains, out = self.start, [None], []
        for byte in data:
            move = state.next.get(byte)
            if move is None:
                move = state.next[byte] = self.step(state, byte)
            state, on, base, token = move
            chain = (token, chains[base])
            if on:
                chains = [chains[k] for k in on]
                chains.append(chain)
            else:  # nothing can change the tokens so far
                out += _unwound(chain)
                chains = [None]
        return out + _unwound(chains[-1])


def _unwound(chain: tuple | None) -> list[int]:
    tokens = []
    while chain:
        tokens.append(chain[0])
        chain = chain[1]
    return tokens[::-1]


#: UTF-8 as a state machine: for each state, ranges of bytes and the state they lead to. 0 is between characters.
_UTF8 = {
    0: ((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2),
        (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)),
    1: ((0x80, 0xBF, 0),),
    2: ((0x80, 0xBF, 1),),
    3: ((0x80, 0xBF, 2),),
    4: ((0xA0, 0xBF, 1),),
    5: ((0x80, 0x9F, 1),),
    6: ((0x90, 0xBF, 2),),
    7: ((0x80, 0x8F, 2),),
}
_MOVES = [{b: to for lo, hi, to in _UTF8[s] for b in range(lo, hi + 1)} for s in range(8)]


class StreamDecoder:
    """Tokens to text, token by token; a character is out when its last byte is in.

    Wrong bytes become U+FFFD, one for each longest start of a character.
    Moves by whole tokens are made from those by bytes and kept.
    """

    def __init__(self, tokens: dict[int, bytes]) -> None:
        self.tokens, self.moves = tokens, {}
        self.whole = {}  # texts of the tokens that hold whole characters
        for token in tokens:
            text, state, _ = self._move(0, b"", token)
            if state == 0 and "\ufffd" not in text:
                self.whole[token] = text

    def _move(self, state: int, held: bytes, token: int) -> tuple[str, int, bytes]:
        out = []
        for byte in self.tokens[token]:
            to = _MOVES[state].get(byte)
            if to is None:
                if held:
                    out.append("�")
                held = b""
                to = _MOVES[0].get(byte)
                if to is None:
                    out.append("�")
                    state = 0
                    continue
            held += bytes((byte,))
            state = to
            if state == 0:
                out.append(held.decode())
                held = b""
        return "".join(out), state, held

    def decode(self, ids: list[int]) -> str:
        try:
            return "".join(map(self.whole.__getitem__, ids))
        except KeyError:
            pass  # some characters go over two tokens
        state, held, out, moves = 0, b"", [], self.moves
        for token in ids:
            key = token if not held else (held, token)
            move = moves.get(key)
            if move is None:
                move = self._move(state, held, token)
                if len(moves) < 500_000:
                    moves[key] = move
            text, state, held = move
            out.append(text)
        return "".join(out) + ("�" if held else "")


#: White space around a space, where the pieces depend on more than the string after it.
_RUN = re.compile(r"\s (?:\s|\Z)")


class Codec:
    """Encoder and decoder of one rank file; ids of strings and pieces are kept as bytes."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        self.transducer = Transducer(self.ranks)
        self.decoder = StreamDecoder(self.transducer.bytes)
        self.pieces = Memo(self._piece)
        self.strings = Memo(lambda s: self._string(" " + s))

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else self.transducer.encode(data)
        return pack(f"<{len(ids)}I", *ids)

    def _string(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers.

        A space between two visible characters always starts a piece, so the
        strings between spaces can be encoded, and kept, one by one.
        """
        if not text:
            return b""
        if _RUN.search(text) or text[0].isspace():
            return self._string(text)
        first, *others = text.split(" ")
        return self._string(first) + b"".join(map(self.strings.__getitem__, others))

    def decode(self, ids: bytes) -> str:
        return self.decoder.decode(np.frombuffer(ids, dtype="<u4").tolist())


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """This worker's codec for a rank file."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of each row of ``docs``; null texts have no ids.

    ``path`` is a rank file that all executors have. Texts are encoded whole;
    strings that look like special tokens are ordinary text. Repeated rows and
    null ids stay; other columns are not read.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = codec(path, pattern)
        for frame in frames:
            ids = [np.frombuffer(known.encode(t), dtype="<u4").astype("int32") for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "ids": ids})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``text`` of rows of ``ids``; null ids give an empty text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = codec(path, pattern)
        for frame in frames:
            texts = [known.decoder.decode([] if x is None else list(x)) for x in frame["ids"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text": texts})

    return encoded.select("doc_id", "ids").mapInPandas(
        run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string"
    )


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode each text in the task that holds it: ``doc_id``, ``n_tokens`` and both digests."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = codec(path, pattern)
        for frame in frames:
            rows = []
            for text in frame["text"]:
                ids = known.encode(text)
                back = known.decode(ids).encode()
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))
            got = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            yield got.astype({"n_tokens": "int64"}).assign(doc_id=frame["doc_id"].values)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
