"""Secret scans: the base rules against a letter-by-letter reading, and the layers by building them."""

import base64
import bz2
import gzip
import lzma
import random
import string
import zlib
from hashlib import sha256
from urllib.parse import quote

from verseloom.llm import secret_scan

KEY = "AKIA" + "Q7RSTUVW" * 2
HEX = "0123456789abcdef" * 3


def slow_base(text):
    """The contract's three rules, without regular expressions."""
    value = set(string.ascii_letters + string.digits + "+/_.=-")
    lower = "".join(c.lower() if c in string.ascii_uppercase else c for c in text)
    found, k = [], 0
    while k < len(text):
        end = None
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if lower.startswith(name, k):
                i = k + len(name)
                for quoted in ((1, 0) if text[i : i + 1] in ('"', "'") and text[i : i + 1] else (0,)):
                    j = i + quoted
                    while text[j : j + 1] == " ":
                        j += 1
                    if text[j : j + 1] in (":", "=") and text[j : j + 1]:
                        j += 1
                        while text[j : j + 1] == " ":
                            j += 1
                        j += text[j : j + 1] in ('"', "'") and bool(text[j : j + 1])
                        s = j
                        while j < len(text) and text[j] in value:
                            j += 1
                        if j > s:
                            end = (s, j)
                            break
            if end:
                break
        if end:
            if end[1] - end[0] >= 8:
                found.append((k, 0, end[1]))
            k = end[1]
        else:
            k += 1
    for kind, head, letters, least in ((1, "AKIA", string.ascii_uppercase + string.digits, 16), (2, "", "0123456789abcdef", 32)):
        k = 0
        while k < len(text):
            j = k + len(head)
            if text.startswith(head, k):
                while j < len(text) and text[j] in letters:
                    j += 1
            if text.startswith(head, k) and j > k + len(head):
                if j - k >= least:
                    found.append((k, kind, j))
                k = j
            else:
                k += 1
    return sorted(found)


def test_base_equals_plain_reading():
    rng = random.Random(5)
    parts = ["password", "PassWd", "secret", "tOken", "api_key", "APIKEY", "AKIA", "AKIAKIA", '"', "'", " ", "  ", ":", "=", "abc", "ABCDEF12", "0f", "a1b2c3d4e5f60718", "ſecret", "toKen", "é", "\n", ".", "-x", "\t"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 18)))
        assert secret_scan.spans_in(text) == slow_base(text), text


def spans(text):
    return secret_scan.scan(text)[1]


def place(text, part):
    return text.index(part), text.index(part) + len(part)


def test_each_layer_maps_to_its_place():
    every = "".join(f"%{b:02x}" for b in KEY.encode())
    text = f"é before {every} after"
    assert spans(text) == [(place(text, every)[0], 1, place(text, every)[1])]
    part = "x" + "".join(f"\\u{ord(c):04x}" for c in KEY[:4]) + KEY[4:]
    assert spans(part + " y") == [(1, 1, len(part))]
    part = "".join(f"&#{ord(c)};" for c in KEY)
    assert spans("z " + part) == [(2, 1, 2 + len(part))]
    coded = base64.b64encode(f"do not read: {KEY} thanks".encode()).decode()
    text = f"Überschrift {coded} end"
    (low, kind, high), = spans(text)
    a = place(text, coded)[0]
    assert kind == 1 and a + 13 * 4 // 3 - 2 <= low <= a + 13 * 4 // 3 + 1 and high <= place(text, coded)[1]
    inner = base64.b64decode(text[low : low + (high - low) // 4 * 4] + "==")
    assert KEY[2:-4].encode() in inner or KEY[4:-4].encode() in base64.b64decode(text[a:high] + "==")


def test_nested_layers_until_nothing_new():
    plain = f"token = {HEX}"
    for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress):
        coded = base64.b64encode(pack(plain.encode())).decode()
        text = f"see {coded}; bye"
        a, b = place(text, coded)
        assert {(k, s, e) for s, k, e in spans(text)} >= {(0, a, b), (2, a, b)}
    text = quote(base64.b64encode(zlib.compress(base64.b64encode(quote(plain).encode()))).decode(), safe="")
    for _ in range(3):
        text = text.replace("%", "%25")
    assert {k for _, k, _ in spans(f"a {text} b")} == {0, 2}
    low, high = min(s for s, _, _ in spans(f"a {text} b")), max(e for _, _, e in spans(f"a {text} b"))
    assert low >= 2 and high <= 2 + len(text)
    deep = plain
    for _ in range(6):
        deep = base64.b64encode(deep.encode()).decode()
    assert {k for _, k, _ in spans(f"({deep})")} == {0, 2} and secret_scan.scan(deep)[2] == 6


def test_copies_have_places_of_their_own():
    coded = base64.b64encode(f"key {KEY} end".encode()).decode()
    found = spans(f"{coded}, {coded}")
    assert len(found) == 2 and found[1][0] - found[0][0] == len(coded) + 2


def test_layers_that_repeat_come_to_an_end(monkeypatch):
    """Data that unpacks to itself: each layer is met once."""
    coded = base64.b64encode(gzip.compress(b"x")).decode()
    monkeypatch.setattr(secret_scan, "unpacked", lambda data: iter([coded] if data[:2] == b"\x1f\x8b" else []))
    assert secret_scan.scan(f"a {coded} b")[2] == 1


def test_clean_and_odd_texts():
    for text in (None, "", "100% sure, 50%ab", "tokens: many", "\\u12", "%", "%%25", "&#;", "====", "A" * 500, "\\ud800 lone", "&#9999999;"):
        assert secret_scan.scan(text)[0] == [] and secret_scan.scan(text)[1] == []
    assert spans("%C3%A9" * 3) == []


def test_long_streams_are_read_in_pieces():
    data = b"lorem ipsum " * 300_000 + f"\npassword={HEX}\n".encode() + b" dolor" * 300_000
    coded = base64.b64encode(gzip.compress(data)).decode()
    assert {k for _, k, _ in spans(f"a {coded} b")} == {0, 2}
    assert max(map(len, secret_scan.unpacked(gzip.compress(data)))) < 2 * secret_scan.PIECE + secret_scan.OVERLAP


def test_table(spark):
    rows = [(1, f"{KEY} password: hunter2hunter2", "x"), (1, f"{KEY} password: hunter2hunter2", "x"), (None, None, "y"), (3, "", "z"), (4, "word " * 200_000 + HEX, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = secret_scan.scan_documents(docs).toPandas()
    assert len(out) == 5
    base = f"access:0:{len(KEY)},assign:{len(KEY) + 1}:{len(KEY) + 25}"
    first = out[out["doc_id"] == 1]
    assert first["spans"].tolist() == [base] * 2 and set(first["base_sha256"]) == {sha256(base.encode()).hexdigest()}
    assert set(out[out["doc_id"].isna()]["base_sha256"]) == {sha256(b"").hexdigest()}
    assert out[out["doc_id"] == 4]["n_hex"].tolist() == [1]
    assert secret_scan.scan_documents(docs.limit(0)).count() == 0
