"""Scalar text functions: fold and tokens."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_map() -> tuple[str, str]:
    """Letters with marks and their bases, one to one; combining marks go (they have no counterpart)."""
    pairs = {}
    for low, high in ((0xC0, 0x24F), (0x1E00, 0x1EFF)):
        for c in map(chr, range(low, high + 1)):
            base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
            if len(base) == 1 and base != c:
                pairs[c] = base
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(pairs) + marks, "".join(pairs.values())


FOLD_FROM, FOLD_TO = _fold_map()


def fold(text: Column) -> Column:
    """Lower case without diacritics; null gives an empty string."""
    return F.lower(F.translate(F.coalesce(text, F.lit("")), FOLD_FROM, FOLD_TO))


def surface_tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, case kept."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def folded_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the folded text."""
    return F.regexp_extract_all(fold(text), F.lit("[a-z0-9]+"), F.lit(0))


_bases = str.maketrans(FOLD_FROM[: len(FOLD_TO)], FOLD_TO, FOLD_FROM[len(FOLD_TO) :])
_runs = re.compile("[a-z0-9]+")


def tokens_of(text: str | None) -> list[str]:
    """``folded_tokens`` of one text, for use inside a task."""
    if not text:
        return []
    return _runs.findall((text if text.isascii() else text.translate(_bases)).lower())


class Kept(dict):
    """Results of a function by token, so many at most."""

    def __init__(self, make, limit: int = 300_000) -> None:
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, token: str):
        if len(self) >= self.limit:
            self.clear()
        found = self[token] = self.make(token)
        return found
