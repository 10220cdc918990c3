"""Marked-up text: plain text of HTML, glossary entries, and safe rendering with highlights."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags that stay, that become a line break, that go; elements whose content is no text.
KEPT = frozenset(("b", "em", "i"))
BREAK = "j"
KNOWN_TAG = re.compile(r"<(/?)(b|em|i|j|a)\b[^>]*>", re.IGNORECASE)
NO_TEXT = frozenset(("script", "style", "template"))
ESCAPES = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&#34;", "'": "&#39;", **dict.fromkeys(map(chr, range(4)))})

_escaping = re.compile(r"""[&<>"'\x00-\x03]""")
_letters = re.compile(r"[^\W\d_]+")


class _Text(HTMLParser):
    """Text nodes of a fragment; what a grammar span holds stands in brackets."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts, self.silent = [], 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in NO_TEXT
        self.parts.append(("[" if tag == "span" and dict(attrs).get("class") == "grammar" else "", True))

    def handle_endtag(self, tag):
        self.silent -= tag in NO_TEXT and self.silent > 0
        self.parts.append(("] " if tag == "span" else "", False))

    def handle_data(self, data):
        if not self.silent:
            self.parts.append((data, None))


def plain_text(html: str | None) -> str:
    """Text of an HTML fragment: a line for each text node, none blank; a bracket stays with the node it encloses."""
    if not html:
        return ""
    parser = _Text()
    parser.feed(html)
    parser.close()
    nodes, open_, fresh = [], "", True
    for text, start in parser.parts:
        if start is None:
            if fresh:
                nodes.append(open_ + text)
            else:
                nodes[-1] += text
            open_, fresh = "", False
        elif start:
            open_, fresh = open_ + text, True
        else:
            if text and nodes and not fresh:
                nodes[-1] += text
            elif text:
                nodes.append(open_ + text)
                open_ = ""
            fresh = True
    return "\n".join(x for n in nodes for line in n.split("\n") if (x := line.strip()))


def clean_html(html: Column) -> Column:
    # a page at a time from the Arrow batch: its pages never stand all as Python strings
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array((plain_text(t.as_py()) for t in texts), pa.string(), size=len(texts))

    return run(html)


def without_tags(html: Column) -> Column:
    """Text of simple markup by built-in functions: breaks are line feeds, other tags blanks, the five usual entities decoded."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>", "\n"), r"<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    text = F.regexp_replace(text, r"[ \t\r]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r" ?\n ?", "\n"), r"\n{2,}", "\n"), r"^\s+|\s+$", "")


def extract_glossary(pages: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Entries of marked-up pages: ``key``, ``entry`` (from 1), ``word``, ``definition``.

    An entry runs from one ``start`` to the next, its headword up to the first
    ``end`` (patterns); entries without headword or definition go.
    """
    parts = pages.select(key, F.posexplode(F.split("html", start, -1)).alias("entry", "part")).where("entry > 0")
    cut = F.split("part", end, 2)
    rows = parts.select(key, "entry", without_tags(F.get(cut, F.lit(0))).alias("word"), without_tags(F.get(cut, F.lit(1))).alias("definition"))
    return rows.where("word != '' and definition != ''")


def folded_with_places(text: str) -> tuple[str, list[int] | range]:
    """Lower case without marks, and the place in ``text`` of each letter of it."""
    if text.isascii():
        return text.lower(), range(len(text))
    out, places = [], []
    for k, c in enumerate(text):
        for x in unicodedata.normalize("NFD", c):
            if not unicodedata.combining(x):
                for low in x.lower():
                    out.append(low)
                    places.append(k)
    return "".join(out), places


class _Letters(dict):
    """Each letter, by code point, in lower case without marks; ``ODD`` for one that becomes none or several."""

    def __missing__(self, code: int) -> str:
        found = folded_with_places(chr(code))[0]
        self[code] = found = found if len(found) == 1 else ODD
        return found


ODD = "\ud800"
_letters_folded = _Letters()


def _in_place(text: str) -> str | None:
    """A text folded letter by letter, each in its place; None if a letter has no single counterpart."""
    low = text.lower() if text.isascii() else text.translate(_letters_folded)
    return None if ODD in low else low


def _places(low: str, part: str) -> list[tuple[int, int]]:
    """Where a part stands in a text, left to right without overlap."""
    found, at, size = [], low.find(part), len(part)
    while at >= 0:
        found.append((at, at + size))
        at = low.find(part, at + size)
    return found


def _is_word(low: str, start: int, end: int) -> bool:
    beside = (low[start - 1 : start], low[end : end + 1])
    return not any(c.isalnum() and not c.isdecimal() for c in beside)


FEW_FORMS = 12  # forms up to which each is looked for by itself


def _spans(text: str, forms: frozenset[str], query: str) -> list[tuple[int, int]]:
    low = _in_place(text) if forms or query else None
    if forms:
        if low is None:
            return [m.span() for m in _letters.finditer(text) if folded_with_places(m[0])[0] in forms]
        if len(forms) > FEW_FORMS:
            return [m.span() for m in _letters.finditer(low) if m[0] in forms]
        words = [f for f in forms if _letters.fullmatch(f)]
        # overlapping places of one form can't both be words, but the second of them can
        return sorted(x for f in words for x in _starts(low, f) if _is_word(low, *x))
    if not query:
        return []
    if low is not None:
        return _places(low, query)
    low, places = folded_with_places(text)
    return [(places[s], places[e - 1] + 1) for s, e in _places(low, query)]


def _starts(low: str, part: str) -> list[tuple[int, int]]:
    """Where a part stands in a text, overlapping places included."""
    found, at = [], low.find(part)
    while at >= 0:
        found.append((at, at + len(part)))
        at = low.find(part, at + 1)
    return found


def _escaped(text: str) -> str:
    return text.translate(ESCAPES) if _escaping.search(text) else text


def rendered(text: str | None, forms: frozenset[str] = frozenset(), query: str = "") -> str | None:
    """HTML of a segment: few tags stay, without attributes; all else is escaped; words of ``forms`` or spans like ``query`` are marked.

    Tags that go join the text around them, so a mark may run across these.
    """
    if not text:
        return None
    pieces, at = [""], 0
    for m in KNOWN_TAG.finditer(text) if "<" in text else ():
        pieces[-1] += text[at : m.start()]
        name, at = m[2].lower(), m.end()
        tag = f"<{m[1]}{name}>" if name in KEPT else "<br>" if name == BREAK and not m[1] else None
        if tag:
            pieces += [tag, ""]
    pieces[-1] += text[at:]
    query = folded_with_places(query)[0]
    for k in range(0, len(pieces), 2):
        piece, done, out = pieces[k], 0, []
        for s, e in _spans(piece, forms, query):
            out += [_escaped(piece[done:s]), f"<mark>{_escaped(piece[s:e])}</mark>"]
            done = e
        pieces[k] = "".join(out) + _escaped(piece[done:])
    return "".join(pieces)


def render_markup(text: Column, forms: Column | None = None, query: Column | None = None) -> Column:
    """``rendered`` over columns: ``forms`` an array of folded words, or ``query`` a string."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, forms: pd.Series, queries: pd.Series) -> pd.Series:
        rows = zip(texts, forms, queries)
        return pd.Series([rendered(t, frozenset(f if f is not None else ()), q or "") for t, f, q in rows], dtype="object")

    none = F.lit(None)
    return run(text, none.cast("array<string>") if forms is None else forms, none.cast("string") if query is None else query)


def deep_link(base: str, text_id: Column, segment_id: Column, template: Column | None = None) -> Column:
    """Link to a segment: ``base/text#segment``, or a caller's ``template`` with {text}, {segment} and {rest} where it is http or https.

    ``{rest}`` is the id behind the colon. A template of another scheme is not used.
    """
    own = F.concat(F.lit(f"{base}/"), text_id, F.coalesce(F.concat(F.lit("#"), segment_id), F.lit("")))
    if template is None:
        return own
    named = template
    for name, value in (("{text}", text_id), ("{segment}", F.coalesce(segment_id, F.lit(""))), ("{rest}", F.regexp_extract(F.coalesce(segment_id, F.lit("")), r"^[^:]*:(.*)$", 1))):
        named = F.replace(named, F.lit(name), value)
    return F.when(F.lower(template).rlike(r"^https?://"), named).otherwise(own)


def citation(text_id: Column, root_title: Column, title: Column, collection: Column) -> Column:
    """"Title (Root title, ID), Collection"; without a title the root title first, without that the id."""
    root = F.coalesce(root_title, text_id)
    short = F.concat(root, F.lit(" ("), F.upper(text_id), F.lit("), "))
    long = F.concat(title, F.lit(" ("), root, F.lit(", "), F.upper(text_id), F.lit("), "))
    return F.concat(F.when(F.coalesce(title, F.lit("")) != "", long).otherwise(short), F.coalesce(collection, F.lit("")))
