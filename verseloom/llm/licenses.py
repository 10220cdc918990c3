"""License scans: exact phrases, and notices found through a positional index of their rarest words.

The index holds, for each word of the notice templates, the templates and
positions it stands at. Of each template the rarest words (by document frequency
over the whole corpus) are looked up: so many that a notice with enough words in
place has at least ``AGREE`` of these in place. Postings that agree on where the
notice starts are a candidate, which counts if enough of the notice's words
stand in place and its mandatory phrases stand in the document near there.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    mandatory: tuple[str, ...]


#: Notices as their licences word them, lower case, without marks.
TEMPLATES = (
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license", "version 3")),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("general public license", "version 2")),
    Template(
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
        ("free software", "general public license"),
    ),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2")),
    Template("mit-notice", "released under the mit license", ("mit license",)),
    Template(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files to deal in the software without restriction",
        ("hereby granted free of charge",),
    ),
    Template("cc-by-nc-4.0", "this work is licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-4.0", "this work is licensed under cc by 4 0", ("cc by 4",)),
    Template("cc-by-sa-4.0", "this work is licensed under cc by sa 4 0", ("cc by sa",)),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        ("source and binary forms",),
    ),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)
AGREE = 2  # postings that must agree on where a notice starts
COVER = 0.6  # share of a notice's words that must stand in place
SHIFT = 2  # words by which postings may differ on where the notice starts

_letters = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: letters and digits of ASCII, and whatever is beyond it."""
    return (text or "").encode().translate(_letters).split()


class Index:
    """Postings of each template's rarest words, by the document frequency of all of them."""

    def __init__(self, templates: tuple[Template, ...], frequency: dict[str, int], n_docs: int) -> None:
        self.templates = [(t.label, t.text.encode().split(), [b" %s " % m.encode() for m in t.mandatory]) for t in templates]
        self.vocabulary = frozenset(w for _, words, _ in self.templates for w in words)
        self.idf = {w: math.log((n_docs + 1) / (frequency.get(w.decode(), 0) + 0.5)) for w in self.vocabulary}
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for k, (_, words, _) in enumerate(self.templates):
            missing = len(words) - next(h for h in range(len(words) + 1) if h >= COVER * len(words))
            for p in sorted(range(len(words)), key=lambda p: (-self.idf[words[p]], p))[: missing + AGREE]:
                self.postings.setdefault(words[p], []).append((k, p))
        self.looked_up = frozenset(self.postings)

    def notices(self, words: list[bytes]) -> dict[str, float]:
        """Labels of the notices in a document, with the share of their words in place."""
        rare = self.looked_up.intersection(words)
        if not rare:
            return {}
        starts: dict[int, Counter] = {}
        for i, w in enumerate(words):
            if w in rare:
                for k, p in self.postings[w]:
                    starts.setdefault(k, Counter())[i - p] += 1
        found: dict[str, float] = {}
        for k, counts in starts.items():
            label, own, mandatory = self.templates[k]
            need = min(AGREE, len(own))
            for start in counts:
                if sum(counts.get(start + d, 0) for d in range(-SHIFT, SHIFT + 1)) < need:
                    continue
                low = max(0, start - SHIFT)
                near = words[low : max(0, start + len(own) + SHIFT)]
                hits = sum(w in near[max(0, start + p - low - SHIFT) : start + p - low + SHIFT + 1] for p, w in enumerate(own))
                line = b" " + b" ".join(near) + b" "
                if hits >= COVER * len(own) and all(m in line for m in mandatory):
                    found[label] = max(found.get(label, 0.0), hits / len(own))
        return found


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """Word number and label of each place of each phrase, overlapping places too."""
    line = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in phrases.items():
        needle, at = b" %s " % phrase.encode(), -1
        counted, number = 0, 0
        while (at := line.find(needle, at + 1)) >= 0:
            number += line.count(b" ", counted, at)
            counted = at
            found.append((number, label))
    return sorted(found)


def document_frequency(docs: DataFrame, words: frozenset[bytes]) -> tuple[dict[str, int], int]:
    """In how many texts each of the given words stands, over all rows; and the number of rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = Counter(), 0
        for frame in frames:
            for text in frame["text"]:
                n += 1
                seen.update(words.intersection(words_of(text)))
        yield pd.DataFrame({"w": ["", *(w.decode() for w in seen)], "n": [n, *seen.values()]})

    rows = docs.select("text").mapInPandas(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    counts = {r["w"]: r["n"] for r in rows}
    return counts, counts.pop("", 0)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Licences of each row of ``docs``.

    ``doc_id``, ``n_words``, ``places`` (word number and label of each phrase),
    ``notices`` (label and share in place of each notice). Null and empty texts
    have no words and no licences; repeated rows and null ids stay; other columns
    are not read.
    """
    vocabulary = Index(templates, {}, 0).vocabulary
    counts, n_docs = document_frequency(docs, vocabulary)
    index = docs.sparkSession.sparkContext.broadcast(Index(templates, counts, n_docs))  # as large as the templates
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = index.value
        for frame in frames:
            rows = []
            for text in frame["text"]:
                words = words_of(text)
                places = [{"word": n, "label": x} for n, x in phrase_places(words, phrases)]
                notices = [{"label": x, "share": s} for x, s in sorted(known.notices(words).items())]
                rows.append((len(words), places, notices))
            got = pd.DataFrame(rows, columns=["n_words", "places", "notices"])
            yield got.assign(doc_id=frame["doc_id"].values)[["doc_id", "n_words", "places", "notices"]]

    return docs.select("doc_id", "text").mapInPandas(
        run,
        f"doc_id {kind}, n_words long, places array<struct<word:long,label:string>>, "
        "notices array<struct<label:string,share:double>>",
    )


def op10_license_scans(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base, more = F.col("places.label"), F.col("notices.label")
    n = F.size("places")
    return found.select(
        "doc_id",
        "n_words",
        n.cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"),
        F.when(n > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("notices.share"), F.lit(0.0))).alias("score"),
    )
