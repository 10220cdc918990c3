"""Whole texts: hierarchy, titles, outlines, slices, languages, editions and exports.

Segments come as ``text_id``, ``segment_id``, ``pos`` (order within the text) and
text columns. Null ids never match; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verseloom.functions.ids import TEXT_ID, id_prefix, id_rest, is_header, is_heading, top_group
from verseloom.operators.outline import natural_key
from verseloom.operators.shared import checkpointed

MAX_WINDOW, MAX_LIMIT = 200, 2000  # of a slice


def stripped(text: Column) -> Column:
    """Without white space at both ends; null where nothing is left."""
    found = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(found != "", found)


def align_languages(root: DataFrame, translations: dict[str, DataFrame]) -> DataFrame:
    """Rows of ``root(segment_id, text, ...)`` that aren't blank, trimmed, with a column ``text_<name>`` of each translation.

    A translation is ``segment_id``, ``text``; blank texts are null, and of
    several rows of a segment the smallest text counts.
    """
    out = root.withColumn("text", stripped(F.col("text"))).where("text is not null")
    for name, t in translations.items():
        one = t.groupBy("segment_id").agg(F.min(stripped(F.col("text"))).alias(f"text_{name}"))
        out = out.join(one, "segment_id", "left")
    return out


def enabled_languages(rows: DataFrame, columns: dict[str, str], enabled: list[str], root: str) -> DataFrame:
    """``rows`` without the text columns of languages that aren't enabled; the root language always stays."""
    return rows.drop(*[c for lang, c in columns.items() if lang not in enabled and lang != root])


def validate_ids(rows: DataFrame, column: str = "text_id", pattern: str = TEXT_ID) -> tuple[DataFrame, DataFrame]:
    """Rows whose id follows the grammar, and the others (null ids among them)."""
    good = F.coalesce(F.col(column).rlike(pattern), F.lit(False))
    return rows.where(good), rows.where(~good)


def flat_hierarchy(levels: list[tuple[DataFrame, str, str | None]]) -> DataFrame:
    """One row for each row of the lowest of some levels, ``(table, key, key of the level above)``, top first."""
    out = levels[0][0]
    for table, _, above in levels[1:]:
        out = table.join(out, above)
    return out


def with_hierarchy(facts: DataFrame, levels: list[tuple[DataFrame, str, str | None]], key: str) -> DataFrame:
    """``facts`` with the columns of all levels above; the levels are joined first, and rows without one go."""
    return facts.join(flat_hierarchy(levels), key)


def structure(levels: list[tuple[DataFrame, str, str | None]], sizes: DataFrame, empty: bool = True) -> DataFrame:
    """Texts and segments below each pair of the two upper levels: ``n_texts``, ``n_segments``, ``active``.

    The last of ``levels`` holds the texts, ``sizes(key, n)`` their numbers of
    segments. Sizes are added up level by level, so no level meets the segments.
    With ``empty`` all branches stay and all texts count; without, texts and
    branches that have no segment go.
    """
    (top, top_key, _), (second, second_key, above) = levels[:2]
    texts, text_key, parent = levels[-1]
    n = texts.join(sizes, text_key, "left").select(F.col(parent).alias("parent"), F.coalesce("n", F.lit(0)).alias("n"))
    counted = F.count("*") if empty else F.count_if(F.col("n") > 0)
    below = n.groupBy("parent").agg(counted.alias("n_texts"), F.sum("n").alias("n_segments"))
    for table, key, up in levels[-2:1:-1]:
        joined = table.select(key, F.col(up).alias("up")).join(below, F.col(key) == F.col("parent"))
        below = joined.groupBy(F.col("up").alias("parent")).agg(F.sum("n_texts").alias("n_texts"), F.sum("n_segments").alias("n_segments"))
    out = top.select(top_key).join(second.select(second_key, F.col(above).alias(top_key)), top_key, "left" if empty else "inner")
    out = out.join(below, F.col(second_key) == F.col("parent"), "left").select(
        top_key,
        second_key,
        F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"),
        F.coalesce("n_segments", F.lit(0)).cast("long").alias("n_segments"),
    )
    out = out.withColumn("active", F.col("n_segments") > 0)
    return out if empty else out.where("active")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    parts = [t.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def clean_title(text: Column) -> Column:
    """Null for blank titles and the mark of an untitled text."""
    found = stripped(text)
    return F.when(found != "~", found)


def text_titles(segments: DataFrame, texts: list[str], curated: DataFrame | None = None) -> DataFrame:
    """The last heading of each text that has one, by text column; a title of ``curated(text_id, ...)`` goes before it."""
    rows = segments.where(is_heading(F.col("segment_id")))
    last = rows.groupBy("text_id").agg(F.max_by(F.struct(*texts), "pos").alias("t"))
    last = last.select("text_id", *[clean_title(F.col("t")[c]).alias(c) for c in texts])
    if curated is None:
        return last
    mine = curated.select("text_id", *[clean_title(F.col(c)).alias(f"own_{c}") for c in texts])
    return last.join(mine, "text_id", "full_outer").select("text_id", *[F.coalesce(f"own_{c}", c).alias(c) for c in texts])


def numbered(segments: DataFrame) -> DataFrame:
    """``segments`` with ``idx``, their place in the text from 0."""
    return segments.withColumn("idx", (F.row_number().over(Window.partitionBy("text_id").orderBy("pos", "segment_id")) - 1).cast("long"))


def outline(segments: DataFrame) -> DataFrame:
    """Sections of each text, without their texts but for the title.

    Where a text has header rows (the id ends in ``.0``) each starts a section,
    and what stands before the first belongs to section 1. Else a new section
    starts where the key changes: the id's part before the colon if the text has
    several, or the number behind it. Section sizes of a text add up to its size.
    """
    own = Window.partitionBy("text_id")
    order = own.orderBy("idx")
    rows = numbered(segments.select("text_id", "segment_id", "pos", "text"))
    rows = rows.withColumns({"h": is_header(F.col("segment_id")), "prefix": id_prefix(F.col("segment_id"))})
    rows = rows.withColumns({"headed": F.max("h").over(own), "several": F.min("prefix").over(own) != F.max("prefix").over(own)})
    rows = rows.withColumn("k", F.when(F.col("several"), F.col("prefix")).otherwise(top_group(F.col("segment_id"))))
    changed = ~F.col("k").eqNullSafe(F.lag("k").over(order)) | (F.col("idx") == 0)
    rows = rows.withColumn("new", F.when(F.col("headed"), F.col("h")).otherwise(changed).cast("long"))
    rows = rows.withColumn("section", F.greatest(F.sum("new").over(order), F.lit(1).cast("long")))
    found = rows.groupBy("text_id", "section").agg(
        F.first("headed").alias("headed"),
        F.min_by("k", "idx").alias("k"),
        F.min_by("segment_id", F.when(F.col("h"), F.col("idx"))).alias("header_segment_id"),
        F.min_by("text", F.when(F.col("h"), F.col("idx"))).alias("title"),
        F.min_by("segment_id", "idx").alias("first_segment_id"),
        F.max_by("segment_id", "idx").alias("last_segment_id"),
        F.min("idx").alias("offset"),
        F.count("*").alias("segment_count"),
    )
    return found.select(
        "text_id",
        "section",
        F.when(F.col("headed"), F.col("section").cast("string")).otherwise(F.col("k")).alias("key"),
        F.when(F.col("headed"), top_group(F.col("header_segment_id"))).otherwise(F.col("k")).alias("grp"),
        "title",
        "header_segment_id",
        "first_segment_id",
        "last_segment_id",
        "offset",
        "segment_count",
    )


REQUEST = "request_id long, text_id string, around string, window int, range_start string, range_end string, offset int, limit int"


def slices(segments: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts of texts for a table of requests (``REQUEST``), and the requests that are rejected, with the reason.

    A request names a text and at most one of: ``around`` with ``window`` (0 to
    200 on each side), ``range_start`` with an inclusive ``range_end`` (open if
    null), or ``offset`` with ``limit`` (1 to 2,000). Without any it gets the
    whole text. Each row tells its page: ``total``, ``offset``, ``returned``,
    ``has_more`` and ``next_offset``. Only requested texts are numbered.
    """
    wanted = numbered(segments.join(requests.select("text_id").distinct(), "text_id", "left_semi"))
    totals = wanted.groupBy("text_id").agg(F.count("*").alias("total"))
    r = requests.join(totals, "text_id", "left")
    for name in ("around", "range_start", "range_end"):
        at = wanted.groupBy("text_id", F.col("segment_id").alias(name)).agg(F.min("idx").alias(f"at_{name}"))
        r = r.join(at, ["text_id", name], "left")
    paged = F.col("offset").isNotNull() | F.col("limit").isNotNull()
    ranged = F.col("range_start").isNotNull() | F.col("range_end").isNotNull()
    modes = F.col("around").isNotNull().cast("int") + ranged.cast("int") + paged.cast("int")
    width = F.least(F.greatest(F.coalesce("window", F.lit(0)), F.lit(0)), F.lit(MAX_WINDOW))
    first = F.least(F.greatest(F.coalesce("offset", F.lit(0)), F.lit(0)), F.col("total"))
    start = (
        F.when(F.col("around").isNotNull(), F.greatest(F.lit(0), F.col("at_around") - width))
        .when(ranged, F.col("at_range_start"))
        .otherwise(first)
    )
    stop = (
        F.when(F.col("around").isNotNull(), F.col("at_around") + width + 1)
        .when(ranged, F.when(F.col("range_end").isNull(), F.col("total")).otherwise(F.col("at_range_end") + 1))
        .when(F.col("limit").isNotNull(), first + F.least(F.greatest("limit", F.lit(1)), F.lit(MAX_LIMIT)))
        .otherwise(F.col("total"))
    )
    missing = lambda name: F.col(name).isNotNull() & F.col(f"at_{name}").isNull()
    error = (
        F.when(F.col("total").isNull(), "unknown text")
        .when(modes > 1, "several selectors")
        .when(ranged & F.col("range_start").isNull(), "range without a start")
        .when(missing("around") | missing("range_start") | missing("range_end"), "unknown segment")
        .when(ranged & (F.col("at_range_end") < F.col("at_range_start")), "range ends before its start")
    )
    r = r.select("request_id", "text_id", "total", start.cast("long").alias("start"), F.least(stop, F.col("total")).cast("long").alias("stop"), error.alias("error"))
    rows = r.where("error is null").join(wanted, "text_id").where("idx >= start and idx < stop")
    rows = rows.select(
        "request_id",
        *segments.columns,
        "idx",
        "total",
        F.col("start").alias("offset"),
        (F.col("stop") - F.col("start")).alias("returned"),
        (F.col("stop") < F.col("total")).alias("has_more"),
        F.when(F.col("stop") < F.col("total"), F.col("stop")).alias("next_offset"),
    )
    return rows, r.where("error is not null").select("request_id", "text_id", "error")


def edition_text(segments: DataFrame, translations: DataFrame, edition: str) -> DataFrame:
    """All ``segments`` with the text of one edition, null where it has none."""
    chosen = translations.where(F.col("edition") == edition).groupBy("segment_id").agg(F.min("text").alias("edition_text"))
    return segments.join(chosen, "segment_id", "left")


def with_fallback(segments: DataFrame, translations: DataFrame, own: str = "text") -> DataFrame:
    """All ``segments``; where ``own`` is blank the text of the first edition, by name, that has one: ``shown``, ``shown_edition``."""
    first = translations.where(stripped(F.col("text")).isNotNull()).groupBy("segment_id").agg(F.min(F.struct("edition", F.col("text").alias("t"))).alias("m"))
    mine = stripped(F.col(own)).isNotNull()
    return segments.join(first, "segment_id", "left").select(
        *segments.columns,
        F.when(mine, F.col(own)).otherwise(F.col("m.t")).alias("shown"),
        F.when(~F.coalesce(mine, F.lit(False)), F.col("m.edition")).alias("shown_edition"),
    )


def editions_of(segments: DataFrame, translations: DataFrame) -> DataFrame:
    """Each segment's editions in order, as an array of (language, edition, translator, text), and how many; none kept."""
    entry = F.struct("language", "edition", "translator", "text")
    found = translations.groupBy("segment_id").agg(F.sort_array(F.collect_list(entry)).alias("editions"))
    return segments.select("segment_id").join(found, "segment_id", "left").select(
        "segment_id", F.coalesce("editions", F.array().cast(found.schema["editions"].dataType)).alias("editions"),
        F.coalesce(F.size("editions"), F.lit(0)).alias("n_editions"),
    )


def pick_translator(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of ``rows(text_id, translator, ...)`` those of each text's first translator in ``order``, and how many texts each has.

    The choice is made by text, not by segment, so that a text has one translator.
    """
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("translator"))
    files = rows.where(F.col("translator").isin(order)).groupBy("text_id").agg(F.min(rank).alias("r"))
    files = files.select("text_id", F.get(F.array(*map(F.lit, order)), F.col("r").cast("int") - 1).alias("translator"))
    return rows.join(files, ["text_id", "translator"]), files.groupBy("translator").agg(F.count("*").alias("n_texts"))


def overlay_translations(shown: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``shown`` rows with the text that a caller gives for their segment, and the given rows that match none."""
    one = given.groupBy("segment_id").agg(F.min("text").alias("given"))
    return shown.join(one, "segment_id", "left"), one.join(shown.select("segment_id"), "segment_id", "left_anti")


def read_texts(
    segments: DataFrame,
    requests: DataFrame,
    columns: dict[str, str],
    languages: list[str],
    root: str,
    curated: DataFrame | None = None,
    translations: DataFrame | None = None,
    translated: str | None = None,
    edition: str | None = None,
    levels: list[tuple] | None = None,
    level: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Requested slices of texts in the chosen languages with the text's title, and the rejected requests.

    With ``translations(segment_id, edition, text)`` the column of the language
    ``translated`` is that of one ``edition`` (null where it has none), or else its
    own text, and where that is blank the first edition's by name. With ``levels``
    each row has the columns of the levels above its key ``level``. Only editions
    of requested segments are looked at.
    """
    rows, rejected = slices(segments, requests)
    titles = text_titles(segments.join(requests.select("text_id").distinct(), "text_id", "left_semi"), [columns[root]], curated)
    if translations is not None and translated in columns:
        own, order = columns[translated], rows.columns
        part = translations.join(rows.select("segment_id").distinct(), "segment_id", "left_semi")
        if edition is not None:
            rows = edition_text(rows, part, edition).withColumn(own, F.col("edition_text"))
        else:
            rows = with_fallback(rows, part, own).withColumn(own, F.col("shown"))
        rows = rows.select(*order)
    if levels is not None:
        rows = with_hierarchy(rows, levels, level)
    rows = rows.join(titles.withColumnRenamed(columns[root], "title"), "text_id", "left")
    return enabled_languages(rows, columns, languages, root), rejected


def export_texts(segments: DataFrame, metadata: DataFrame) -> DataFrame:
    """One JSON document a text, with its metadata and its segments in order; ``write.text`` takes ``value``."""
    rows = segments.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("pos", "segment_id", "text"))).alias("segments"))
    joined = metadata.join(rows, "text_id", "left")
    return joined.select("text_id", F.to_json(F.struct(*[F.col(c) for c in metadata.columns], "segments"), {"ignoreNullFields": "false"}).alias("value"))


def neighbours(texts: DataFrame, book: list[str], number: str, width: int = 10_000) -> DataFrame:
    """Previous and next of ``texts`` in their book by ``number``, a unique long column; the ends have none.

    The book's numbers are cut into ranges of ``width``, each a window of its
    own; the ends of a range then look at the ranges beside it, so a large book
    isn't one task's.
    """
    rows = texts.select(*book, number, F.floor(F.col(number) / width).alias("part"))
    inner = Window.partitionBy(*book, "part").orderBy(number)
    rows = rows.withColumns({"previous": F.lag(number).over(inner), "next": F.lead(number).over(inner)})
    ends = rows.groupBy(*book, "part").agg(F.min(number).alias("low"), F.max(number).alias("high"))
    outer = Window.partitionBy(*book).orderBy("part")
    ends = ends.select(*[F.col(c).alias(f"b_{c}") for c in book], F.col("part").alias("b_part"), F.lag("high").over(outer).alias("before"), F.lead("low").over(outer).alias("behind"))
    same = F.col("part") == F.col("b_part")
    for c in book:
        same = same & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    return rows.join(ends, same).select(number, *book, F.coalesce("previous", "before").alias("previous"), F.coalesce("next", "behind").alias("next"))


def natural_neighbours(texts: DataFrame, segments: DataFrame, book: list[str], key: str = "text_id", shown: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """``previous`` and ``next`` of each text that has segments, in its book by natural order of the ids: x9 before x10, whatever lies between.

    Each is a struct of the id and the columns ``shown`` (titles), null at the ends
    of a book. Texts of ``segments`` without any row are skipped. All texts are cut
    into ranges by book and natural id; a window runs within a range, and the ends
    of the ranges, one row each, are then looked up from one to the next, so a
    large book isn't one task's. Null books are one book.
    """
    there = texts.join(segments.select(key).distinct(), key, "left_semi").select(*book, key, *shown)
    rows = there.withColumn("__natural", natural_key(F.col(key)))
    return stitched(rows, book, ["__natural", key], F.struct(key, *shown), ranges).select(key, *book, *shown, "previous", "next")


def stitched(rows: DataFrame, book: list[str], order: list[str], one: Column, ranges: int | None = None) -> DataFrame:
    """``rows`` with ``previous`` and ``next``, the value ``one`` of the rows beside each in its book by ``order``, cut into ranges as ``natural_neighbours`` says."""
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, *book, *order)
    rows = checkpointed(rows.withColumn("__range", F.spark_partition_id()))
    inner = Window.partitionBy(*book, "__range").orderBy(*order)
    rows = rows.withColumns({"previous": F.lag(one).over(inner), "next": F.lead(one).over(inner)})
    ends = rows.groupBy(*book, "__range").agg(F.min_by(one, F.struct(*order)).alias("low"), F.max_by(one, F.struct(*order)).alias("high"))
    outer = Window.partitionBy(*book).orderBy("__range")
    ends = ends.select(*[F.col(c).alias(f"__b_{c}") for c in book], F.col("__range").alias("__b_range"), F.lag("high").over(outer).alias("before"), F.lead("low").over(outer).alias("behind"))
    same = F.col("__range") == F.col("__b_range")
    for c in book:
        same = same & F.col(c).eqNullSafe(F.col(f"__b_{c}"))
    sides = {"previous": F.coalesce("previous", "before"), "next": F.coalesce("next", "behind")}
    return rows.join(ends, same).withColumns(sides).drop("__range", "__b_range", "before", "behind", *[f"__b_{c}" for c in book])


def order_rules(segments: DataFrame, ranges: int | None = None) -> DataFrame:
    """Number of rows that break each rule of order within a text: places start at 0 and have no gap, and ids rise with them in natural order.

    A row is held against the one before it only; long texts are cut into ranges.
    """
    rows = segments.select("text_id", "pos", natural_key(F.col("segment_id")).alias("__id"))
    rows = stitched(rows, ["text_id"], ["pos", "__id"], F.struct("pos", "__id"), ranges)
    found = rows.agg(
        F.count_if(F.col("previous").isNull() & (F.col("pos") != 0)).alias("first place isn't 0"),
        F.count_if(F.col("pos") - F.col("previous.pos") > 1).alias("gap before the place"),
        F.count_if(F.col("__id") <= F.col("previous.__id")).alias("id not above the one before"),
    )
    return found.unpivot([], found.columns, "rule", "n")


def orphan_rules(links: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """For each named link ``(rows, key, parents, parent key)`` the number of rows whose key, null ones apart, no parent has."""
    out = None
    for name, (rows, key, parents, own) in links.items():
        known = parents.select(F.col(own).alias("__own")).distinct()
        lost = rows.select(F.col(key).alias("__key")).where("__key is not null").join(known, F.col("__key") == F.col("__own"), "left_anti")
        part = lost.agg(F.lit(name).alias("rule"), F.count("*").alias("n"))
        out = part if out is None else out.union(part)
    return out


def pinned_differences(found: DataFrame, pinned: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``pinned`` whose counts aren't those of ``found``: the keys, and ``expected`` and ``got`` as structs (null: no such row)."""
    counts = [c for c in pinned.columns if c not in keys]
    want = pinned.select(*keys, F.struct(*counts).alias("expected"))
    have = found.select(*keys, F.struct(*[F.col(c).cast(pinned.schema[c].dataType).alias(c) for c in counts]).alias("got"))
    return want.join(have, keys, "left").where(~F.col("expected").eqNullSafe(F.col("got")))


def nest(levels: list[tuple[DataFrame, str, str | None, Column]], name: str = "children", empty: bool = False) -> DataFrame:
    """Levels of a hierarchy as one row of the first level each, with all below in arrays.

    A level is ``(table, key, parent, order)``, the first without a parent; a key of
    one is the parent column of the next. Built from the last level up, one grouping
    a level; arrays stand in ``order``, then by all columns. ``total`` tells the rows
    of the last level; a row with none below goes unless ``empty``. A row holds all
    that lies below it, as the document it becomes does.
    """
    below = None
    for table, key, parent, order in reversed(levels):
        rows = table if below is None else table.join(below, key, "left" if empty else "inner")
        total = F.lit(1).cast("long") if below is None else F.coalesce("total", F.lit(0).cast("long"))
        rows = rows.withColumn("total", total)
        if parent is None:
            return rows
        shown = [c for c in rows.columns if c not in (parent, "total")]
        item = F.struct(order.alias("o"), F.struct(*shown, *([] if below is None else ["total"])).alias("v"))
        grouped = rows.where(F.col(parent).isNotNull()).groupBy(parent)
        below = grouped.agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["v"]).alias(name), F.sum("total").alias("total"))
    raise ValueError("the first level has no parent")


def export_documents(rows: DataFrame, key: str) -> DataFrame:
    """``key`` and ``value``, the row as one line of JSON with nulls kept: of nested levels, of word reports, of anything."""
    return rows.select(key, F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def corpus_rules(segments: DataFrame, least: DataFrame | None = None) -> DataFrame:
    """Number of rows that break each rule of ids and order; ``least(text_id, n)`` names smallest sizes.

    The id's text may be a member of a range: its letters must equal those of the text.
    """
    book = lambda c: F.regexp_extract(c, "^[a-z-]*", 0)
    one = segments.agg(
        F.count_if(F.col("segment_id").isNull()).alias("null segment id"),
        F.count_if(~F.coalesce(F.col("text_id").rlike(TEXT_ID), F.lit(False))).alias("text id not by the grammar"),
        F.count_if(F.regexp_replace(book(id_prefix(F.col("segment_id"))), "-$", "") != F.regexp_replace(book(F.col("text_id")), "-$", "")).alias("segment of another book"),
        F.count_if(id_rest(F.col("segment_id")) == "").alias("segment id without a number"),
    )
    out = one.unpivot([], one.columns, "rule", "n")
    out = out.union(segments.groupBy("segment_id").count().where("count > 1").agg(F.lit("repeated segment id"), F.count("*")))
    out = out.union(segments.groupBy("text_id", "pos").count().where("count > 1").agg(F.lit("repeated place"), F.count("*")))
    if least is not None:
        sizes = segments.groupBy("text_id").agg(F.count("*").alias("have"))
        small = least.join(sizes, "text_id", "left").where(F.coalesce("have", F.lit(0)) < F.col("n"))
        out = out.union(small.agg(F.lit("smaller than expected"), F.count("*")))
    return out
