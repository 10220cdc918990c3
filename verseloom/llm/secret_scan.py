"""Secret scans over a text and over all that is encoded in it.

A worklist of layers: the text itself, then whatever URL escapes, Unicode escapes,
base64 and compressed data in a layer decode to, until nothing new comes. Each
layer is scanned by the same patterns, and what is found is mapped back to the
place in the text that it was decoded from.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import lzma
import re
import zlib
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
MIN_VALUE = 8
#: As the contract has them; maximal runs, so the least lengths of the last two are part of the pattern.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: One of these is in every text with an assignment.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
LETTERS = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
LETTER = re.compile(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}={0,2}")
CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f�]")
PIECE, OVERLAP = 1 << 20, 1 << 13  # of a decompressed stream: what is scanned at a time, and how far pieces overlap


def spans_in(text: str) -> list[tuple[int, int, int]]:
    """``start``, kind (by number) and ``end`` of the base matches of a text, leftmost and non-overlapping in each kind."""
    found = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


class Layer:
    """A decoded text and, for each of its letters, the places in the raw text that it starts and ends at (none: the raw text itself)."""

    def __init__(self, text: str, low: np.ndarray | None = None, high: np.ndarray | None = None) -> None:
        self.text, self.low, self.high = text, low, high

    def raw(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.low is None else (int(self.low[start]), int(self.high[end - 1]))

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        if self.low is None:
            at = np.arange(len(self.text), dtype=np.int64)
            return at, at + 1
        return self.low, self.high

    def key(self) -> tuple:
        """What tells one layer from another: where it comes from and what it says."""
        return (*self.raw(0, len(self.text)), sha256(self.text.encode("utf-8", "surrogatepass")).digest())

    def replaced(self, parts: list[tuple[int, int, list[tuple[str, int, int]]]]) -> Layer:
        """This layer with some stretches decoded; a part is its start, its end, and each letter with its place in the layer."""
        low, high = self.ends()
        text, lows, highs, at = [], [], [], 0
        for start, end, letters in parts:
            text += [self.text[at:start], *(c for c, _, _ in letters)]
            lows += [low[at:start], low[[a for _, a, _ in letters]]]
            highs += [high[at:start], high[[b - 1 for _, _, b in letters]]]
            at = end
        text.append(self.text[at:])
        return Layer("".join(text), np.concatenate((*lows, low[at:])), np.concatenate((*highs, high[at:])))


def _pieces(data: bytes) -> Iterator[bytes] | None:
    """The content of compressed data, a piece at a time, as far as it can be read; None for other data."""
    if data[:2] == b"\x1f\x8b" or len(data) > 2 and data[0] == 0x78 and int.from_bytes(data[:2], "big") % 31 == 0:
        stream, room = zlib.decompressobj(47), "unconsumed_tail"
    elif data[:3] == b"BZh":
        stream, room = bz2.BZ2Decompressor(), ""
    elif data[:6] == b"\xfd7zXZ\x00":
        stream, room = lzma.LZMADecompressor(), ""
    else:
        return None

    def read() -> Iterator[bytes]:
        left = data
        try:
            while not stream.eof:
                out = stream.decompress(left, PIECE)
                left = getattr(stream, room) if room else b""
                if out:
                    yield out
                elif not left and (room or stream.needs_input):
                    return
        except (zlib.error, OSError, lzma.LZMAError, EOFError):
            return

    return read()


def unpacked(data: bytes) -> Iterator[str]:
    """Text of compressed data in overlapping pieces; any bytes that aren't UTF-8 are replaced."""
    decoder, held = codecs.getincrementaldecoder("utf-8")("replace"), ""
    for piece in _pieces(data) or ():
        held += decoder.decode(piece)
        if len(held) >= PIECE:
            yield held
            held = held[-OVERLAP:]
    if held:
        yield held


def _letters_of(data: bytes, place) -> list[tuple[str, int, int]]:
    """Letters of UTF-8 bytes with the places of their first and last byte; a byte that is none stands for its own code point."""
    out, k = [], 0
    while k < len(data):
        size = 1 if data[k] < 0x80 else 2 if data[k] < 0xE0 else 3 if data[k] < 0xF0 else 4
        try:
            c = data[k : k + size].decode()
        except UnicodeDecodeError:
            c, size = chr(data[k]), 1
        out.append((c, place(k)[0], place(min(k + size, len(data)) - 1)[1]))
        k += size
    return out


def _code(escape: str) -> int:
    if escape[0] == "&":
        return int(escape[3:-1], 16) if escape[2] in "xX" else int(escape[2:-1])
    return int(escape[2:], 16)


def url_layers(layer: Layer) -> Iterator[Layer]:
    """The layer with its URL escapes decoded, and the text of those that hold compressed data."""
    if "%" not in layer.text:
        return
    parts = []
    for m in ESCAPES.finditer(layer.text):
        data = bytes.fromhex(m[0].replace("%", ""))
        for text in unpacked(data):
            yield _as_one(layer, text, m.start(), m.end())
        parts.append((m.start(), m.end(), _letters_of(data, lambda k, s=m.start(): (s + 3 * k, s + 3 * k + 3))))
    if parts:
        yield layer.replaced(parts)


def unicode_layers(layer: Layer) -> Iterator[Layer]:
    """The layer with its Unicode escapes decoded; two halves of a pair become one letter."""
    if "\\" not in layer.text and "&#" not in layer.text:
        return
    parts = []
    for run in LETTERS.finditer(layer.text):
        letters: list[tuple[str, int, int]] = []
        for m in LETTER.finditer(layer.text, run.start(), run.end()):
            code = _code(m[0])
            if 0xDC00 <= code < 0xE000 and letters and "\ud800" <= letters[-1][0] < "\udc00":
                first, start, _ = letters.pop()
                letters.append((chr(0x10000 + (ord(first) - 0xD800 << 10) + code - 0xDC00), start, m.end()))
            else:
                letters.append((chr(code) if code < 0x110000 else "�", m.start(), m.end()))
        parts.append((run.start(), run.end(), letters))
    if parts:
        yield layer.replaced(parts)


def _as_one(layer: Layer, text: str, start: int, end: int) -> Layer:
    """A text whose letters all stand for one stretch of the layer."""
    low, high = layer.raw(start, end)
    return Layer(text, np.full(len(text), low), np.full(len(text), high))


def base64_layers(layer: Layer) -> Iterator[Layer]:
    """What each run of base64 letters stands for: text, or compressed data; anything else is no layer."""
    for m in BASE64.finditer(layer.text):
        run = m[0].rstrip("=")
        skip = (len(m[0]) % 4 if len(m[0]) > len(run) else 0) or 0  # padding tells where the groups end
        run = run[skip:]
        run = run[:-1] if len(run) % 4 == 1 else run
        data = base64.b64decode(run.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4))
        start = m.start() + skip
        if (pieces := _pieces(data)) is not None:
            pieces.close()
            for text in unpacked(data):
                yield _as_one(layer, text, m.start(), m.end())
            continue
        try:
            text = data.decode()
        except UnicodeDecodeError:
            continue
        if not CONTROL.search(text):
            letters = _letters_of(data, lambda k, s=start: (s + 8 * k // 6, s + -(-8 * (k + 1) // 6)))
            low, high = layer.ends()
            yield Layer(text, low[[a for _, a, _ in letters]], high[[b - 1 for _, _, b in letters]])


def layers_below(layer: Layer) -> Iterator[Layer]:
    return chain(url_layers(layer), unicode_layers(layer), base64_layers(layer))


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Base spans of a text, all spans (those of its layers too), and the number of layers below the text.

    A layer that was met before at the same place ends its branch, so data that
    unpacks to itself comes to an end.
    """
    if not text:
        return [], [], 0
    base = spans_in(text)
    found, seen, work = set(base), set(), [layers_below(Layer(text))]
    while work:  # depth first, so that one layer of each depth is held
        if (layer := next(work[-1], None)) is None:
            work.pop()
        elif layer.text and (key := layer.key()) not in seen:
            seen.add(key)
            work.append(layers_below(layer))
            for start, kind, end in spans_in(layer.text):
                low, high = layer.raw(start, end)
                found.add((low, kind, high))
    return base, sorted(found), len(seen)


def scan_documents(docs: DataFrame) -> DataFrame:
    """Spans of each row of ``docs``: ``doc_id``, counts of the base kinds, ``base_sha256``, ``spans`` of all layers and ``n_layers``.

    Spans are ``kind:start:end`` in code points of the whole text, end exclusive,
    by start, then kind, then end; one found in several layers at one place counts
    once. Null and empty texts have none; repeated rows and null ids stay; an empty
    table gives an empty result; other columns are not read. A decompressed stream
    is scanned in pieces that overlap, so its size is not held in memory.
    """
    kind = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long"

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = []
            for text in texts:
                base, spans, layers = scan(text)
                counts = [sum(k == x for _, k, _ in base) for x in range(len(KINDS))]
                rows.append((*counts, sha256(joined(base).encode()).hexdigest(), joined(spans), layers))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers"])

    return docs.select("doc_id", run("text").alias("found")).select("doc_id", "found.*")


def op12_secret_scans(spark, sf_dir: str) -> DataFrame:
    return scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
