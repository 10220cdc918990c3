"""Identifiers that carry structure: text ids, segment ids and what can be read off them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The grammars of ids.
TEXT_ID = r"^[a-z]{2,10}(-[a-z]+)*[0-9]*(-[0-9]+)?(\.[0-9]+(-[0-9]+)?){0,4}[a-z]?$"
SEGMENT_ID = r"^[a-z0-9.:\-]{1,80}$"
HEADING = r":0\.[0-9]+$"


def id_prefix(segment_id: Column) -> Column:
    """What stands before the first colon; the whole id without one."""
    return F.substring_index(segment_id, ":", 1)


def id_rest(segment_id: Column) -> Column:
    """What stands behind the first colon; empty without one."""
    return F.regexp_extract(segment_id, r"^[^:]*:(.*)$", 1)


def top_group(segment_id: Column) -> Column:
    """The first component behind the colon: the group that a section stands in."""
    return F.substring_index(id_rest(segment_id), ".", 1)


def paragraph_key(segment_id: Column) -> Column:
    """The id without its last component."""
    return F.regexp_replace(segment_id, r"\.[^.]*$", "")


def book_prefix(text_id: Column) -> Column:
    """The leading run without digits, without hyphens and dots at its end; the id itself where that is empty."""
    head = F.regexp_replace(F.regexp_extract(text_id, r"^[^0-9]*", 0), r"[-.]+$", "")
    return F.when(head == "", text_id).otherwise(head)


def is_heading(segment_id: Column) -> Column:
    return F.coalesce(segment_id.rlike(HEADING), F.lit(False))


def is_header(segment_id: Column) -> Column:
    """Rows that start a section: the rest of the id ends in ``.0``."""
    return F.coalesce(F.endswith(id_rest(segment_id), F.lit(".0")), F.lit(False))


def in_sources(text_id: Column, sources: list[str]) -> Column:
    """Whether the book is one of ``sources`` or of a family that one of them names, up to a hyphen; all without any."""
    if not sources:
        return F.lit(True)
    book = book_prefix(text_id)
    found = book.isin(sources)
    for s in sources:
        found = found | F.startswith(book, F.lit(f"{s}-"))
    return found


def parse_sources(raw: str | None, presets: dict[str, tuple[str, ...]], known: frozenset[str]) -> list[str]:
    """Books of a comma-separated list of names and presets; unknown names go, so that a typo widens the search."""
    names = (raw or "").lower().replace(" ", "").split(",")
    return sorted({b for n in names if n for b in presets.get(n, (n,)) if b in known})


def stratum(text_id: Column, strata: dict[str, int], family: str, of_family: int, other: int) -> Column:
    """The layer of a text's book: by table, by family, else ``other``."""
    book = book_prefix(text_id)
    table = F.create_map(*[F.lit(x) for pair in strata.items() for x in pair])
    return F.coalesce(F.element_at(table, book), F.when(F.startswith(book, F.lit(family)), of_family).otherwise(other))


def decode_id(text_id: Column, names: dict[str, str], single: dict[str, str], dotted: dict[str, tuple[str, str]], parts: dict[str, str], family: str) -> Column:
    """A readable name of a text id: the longest known prefix, then its numbers; unknown ids stay, null gives ''.

    Ids of ``family`` are named part by part between hyphens.
    """
    low = F.lower(F.trim(text_id))

    def lookup(table: dict, key: Column) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)

    book = F.regexp_extract(low, r"^(" + "|".join(sorted(names, key=len, reverse=True)) + r")([0-9.\-]*)$", 1)
    numbers = F.regexp_extract(low, r"^(" + "|".join(sorted(names, key=len, reverse=True)) + r")([0-9.\-]*)$", 2)
    name = lookup(names, book)
    dot = F.lit(" · ")
    two = F.regexp_extract(numbers, r"^([0-9]+)\.([0-9]+)$", 1), F.regexp_extract(numbers, r"^([0-9]+)\.([0-9]+)$", 2)
    first = lookup({k: v[0] for k, v in dotted.items()}, book)
    second = lookup({k: v[1] for k, v in dotted.items()}, book)
    plain = (
        F.when(numbers == "", name)
        .when(numbers.rlike(r"^[0-9]+-[0-9]+$"), F.concat(name, dot, F.lit("verses "), F.replace(numbers, F.lit("-"), F.lit("–"))))
        .when(numbers.rlike(r"^[0-9]+$"), F.concat(name, dot, F.coalesce(lookup(single, book), F.lit("sutta")), F.lit(" "), numbers))
        .when(numbers.rlike(r"^[0-9]+\.[0-9]+$") & first.isNotNull(), F.concat(name, dot, first, F.lit(" "), two[0], F.lit(", "), second, F.lit(" "), two[1]))
        .otherwise(F.concat(name, dot, numbers))
    )

    def component(p: Column) -> Column:
        word, number = F.regexp_extract(p, r"^([a-z]+)([0-9]+)$", 1), F.regexp_extract(p, r"^([a-z]+)([0-9]+)$", 2)
        return F.when(word != "", F.concat(F.coalesce(lookup(parts, word), word), F.lit(" "), number)).otherwise(F.coalesce(lookup(parts, p), p))

    walked = F.array_join(F.transform(F.filter(F.split(low, "-"), lambda p: p != ""), component), " · ")
    return F.when(F.coalesce(text_id, F.lit("")) == "", "").when(F.startswith(low, F.lit(family)), F.concat(F.lit("Vinaya · "), walked)).when(book != "", plain).otherwise(text_id)
