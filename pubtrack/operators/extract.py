"""Rows from page text: heading context, line grammar, page geometry, explicit facts.

Input is a table of lines (document, page, line number, text) or of words with their boxes. Scans
are ordered by reading position and split over slices, so one very long document is no hot spot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubtrack.functions.text import fold_upper
from pubtrack.functions.values import short_id
from pubtrack.operators.history import as_of_previous
from pubtrack.operators.scan import last_known, ordered_scan, previous, rank
from pubtrack.session import cut, small_side


def text_lines(documents: DataFrame, document: Sequence[str], text: str) -> DataFrame:
    """Numbered lines of a text."""
    return documents.select(*document, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def heading_context(lines: DataFrame, document: Sequence[str], position: Sequence[Column], headings: Mapping[str, Column]) -> DataFrame:
    """Latest heading of every level at each line. A heading clears the levels below it: a lower
    one counts only when it stands after every higher one. Order of ``headings`` is the hierarchy."""
    place = F.struct(*[c.alias(f"p{i}") for i, c in enumerate(position)])
    steps = [last_known(f"_h_{name}", F.when(value.isNotNull(), F.struct(place.alias("at"), value.alias("value"))))
             for name, value in headings.items()]
    scanned = ordered_scan(lines, document, position, steps)
    newest = None
    for name in headings:
        here = F.col(f"_h_{name}")
        valid = here.isNotNull() if newest is None else here.isNotNull() & (newest.isNull() | (here["at"] > newest))
        scanned = scanned.withColumn(name, F.when(valid, here["value"]))
        newest = here["at"] if newest is None else F.greatest(newest, here["at"])
    return scanned.drop(*[f"_h_{name}" for name in headings])


def until_marker(lines: DataFrame, document: Sequence[str], page: str, marker: Column) -> DataFrame:
    """Lines before the first page that carries the end marker; ``ended`` is false without one."""
    first = lines.groupBy(*document).agg(F.min(F.when(marker, F.col(page))).alias("_end"))
    met = lines.join(first, list(document)).withColumn("ended", F.col("_end").isNotNull())
    return met.where(F.col("_end").isNull() | (F.col(page) < F.col("_end"))).drop("_end")


def page_sequence(pages: DataFrame, document: Sequence[str], order: Sequence[Column], number: str, header: str) -> DataFrame:
    """Per document: breaks in the page numbers and whether all pages show one header."""
    scanned = ordered_scan(pages, document, order, [previous("_before", F.col(number))])
    broken = F.col("_before").isNotNull() & (F.col(number) != F.col("_before") + 1)
    return scanned.groupBy(*document).agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(broken).alias("breaks"), F.min(number).alias("first_page"),
        (F.min(header) == F.max(header)).alias("same_header"))


@dataclass(frozen=True)
class RosterLayout:
    """Line grammar of a ranked list. The patterns are the reviewed layout of the source."""

    # Printed forms of the lines of a list page.
    body: str = r"Cuerpo: (\d{4}) (.+)"
    specialty: str = r"Especialidad: (\d{3}) (.+)"
    block: str = r"Lista: (\d{1,3}) (.+)"
    row: str = r"(\d{7,8}) (?:\*{3}\d{4}\*{2}|\*{4}\d{4}\*) (.+, .+) (\d+\.\d{4})"
    footer: str = r"Página (\d+)"
    end: Sequence[str] = ("RELACIÓN DEFINITIVA DEL PERSONAL INTERINO", "EXCLUIDO")
    required: Sequence[str] = field(default=())
    ignored: Sequence[str] = field(default=())


def parse_roster(lines: DataFrame, layout: RosterLayout, document: str = "doc", page: str = "page", line_no: str = "line_no",
                 text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Members with ordinal rank, and violations. The first page is the cover; reading ends before
    the page with the end marker. A document with any violation must not be published.

    Masked identity numbers and scores are matched but never kept.
    """
    whole = F.col(text)

    def part(pattern: str, group: int) -> Column:
        return F.when(F.rlike(whole, F.lit(f"^(?:{pattern})$")), F.regexp_extract(whole, f"^(?:{pattern})$", group))

    pages = lines.groupBy(document, page).agg(
        *[F.bool_or(F.contains(whole, F.lit(m))).alias(f"_m{i}") for i, m in enumerate(layout.end)],
        *[F.bool_or(whole == F.lit(m)).alias(f"_r{i}") for i, m in enumerate(layout.required)],
        F.max_by(text, line_no).alias("_last"))
    marker = F.lit(True)
    for i in range(len(layout.end)):
        marker = marker & F.col(f"_m{i}")
    ended = pages.where(marker & (F.col(page) > 1)).groupBy(document).agg(F.min(page).alias("_end"))
    first = pages.select(document).distinct().join(ended, document, "left")
    body_pages = pages.join(first, document).where((F.col(page) > 1) & (F.col("_end").isNull() | (F.col(page) < F.col("_end"))))
    complete = F.lit(True)
    for i in range(len(layout.required)):
        complete = complete & F.col(f"_r{i}")
    printed = F.regexp_extract("_last", f"^(?:{layout.footer})$", 1).try_cast("int")
    page_faults = body_pages.select(document, page, F.lit(None).cast("int").alias(line_no), F.array_compact(F.array(
        F.when(~F.coalesce(printed == F.col(page) - 1, F.lit(False)), F.lit("page_sequence")),
        F.when(~complete, F.lit("page_heading")))).alias("_v"))
    missing = first.where(F.col("_end").isNull()).select(document, F.lit(None).cast("int").alias(page), F.lit(None).cast("int").alias(line_no),
                                                         F.array(F.lit("no_end_marker")).alias("_v"))
    body = lines.join(body_pages.select(document, page), [document, page], "left_semi")
    pair = lambda pattern: F.when(part(pattern, 1).isNotNull(), F.struct(part(pattern, 1).alias("code"), part(pattern, 2).alias("name")))
    # Stored: two more ordered scans follow, and the bounds of one scan inside those of another are more than the optimizer takes.
    placed = cut(heading_context(body, [document], [F.col(page), F.col(line_no)],
                                 {"body": pair(layout.body), "specialty": pair(layout.specialty), "block": pair(layout.block)}))
    known = F.rlike(whole, F.lit("^(?:%s)$" % "|".join([layout.body, layout.specialty, layout.block, layout.row, layout.footer])))
    unknown = placed.where(~known & ~whole.isin([*layout.ignored, *layout.required])).select(
        document, page, line_no, F.array(F.lit("unrecognised_line")).alias("_v"))
    rows = placed.where(part(layout.row, 1).isNotNull()).select(
        document, page, line_no, F.concat(F.col("body.code"), F.col("specialty.code")).alias("specialty"),
        F.col("specialty.name").alias("specialty_name"), F.col("body.name").alias("body_name"), F.col("block.code").alias("block"),
        F.col("block.name").alias("block_name"), part(layout.row, 1).alias("list_number"), part(layout.row, 2).alias("name"))
    ranked = ordered_scan(rows, [document, "specialty"], [F.col(page), F.col(line_no)], [rank("rank")])
    ordered = ordered_scan(ranked, [document, "specialty", "block"], [F.col(page), F.col(line_no)], [
        previous("_before", F.col("list_number").cast("long"))])
    row_faults = ordered.select(document, page, line_no, F.array_compact(F.array(
        F.when(F.col("specialty").isNull() | F.col("block").isNull(), F.lit("no_context")),
        F.when(F.col("list_number").cast("long") <= F.col("_before"), F.lit("unordered_number")))).alias("_v"))
    search = fold_upper(F.col("name"))
    members = ordered.drop("_before").withColumn("search_name", search).withColumn(
        "id", short_id(F.concat_ws("|", "specialty", "block", "list_number", search), 32))
    faults = page_faults.unionByName(missing).unionByName(unknown).unionByName(row_faults)
    return members, faults.select(document, page, line_no, F.explode("_v").alias("violation"))


def section_lines(lines: DataFrame, document: Sequence[str], position: Sequence[Column], starts: Column, ends: Column) -> DataFrame:
    """Lines of a section: from each start line to the next end line, both left out."""
    mark = F.when(starts, F.lit(True)).when(ends, F.lit(False))
    scanned = ordered_scan(lines, document, position, [last_known("_inside", mark)])
    return scanned.where(F.coalesce("_inside", F.lit(False)) & ~F.coalesce(starts, F.lit(False))).drop("_inside")


def compare_operations(found: DataFrame, expected: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Operations read from an amendment against the reviewed list of operations, as multisets."""
    from pubtrack.operators.diff import multiset_difference

    gap = multiset_difference(found, expected, columns)
    return gap.withColumn("problem", F.when(F.col("left_count") > F.col("right_count"), "unexpected").otherwise("not_found"))


def words_to_cells(words: DataFrame, columns: Sequence[tuple[str, float, float]], page_keys: Sequence[str], row: str) -> DataFrame:
    """Text of every row and column: words whose left edge lies in the x-range of the column, in
    reading order. ``columns`` is the closed list of ranges (label, from, to) of the layout."""
    label = F.lit(None).cast("string")
    for name, low, high in columns:
        label = F.when((F.col("x0") >= low) & (F.col("x0") < high), F.lit(name)).otherwise(label)
    met = words.withColumn("label", label).where("label IS NOT NULL")
    # A cell is one rectangle of one printed row: its word list is bounded by the page.
    ordered = F.array_sort(F.collect_list(F.struct(F.round("top").alias("t"), F.col("x0").alias("x"), F.col("text").alias("w"))))
    return met.groupBy(*page_keys, row, "label").agg(F.array_join(F.transform(ordered, lambda s: s["w"]), " ").alias("cell"))


def words_to_bands(words: DataFrame, bands: DataFrame, page_keys: Sequence[str], at: str) -> DataFrame:
    """Row rectangle of every anchor. Exactly one must contain it: ``band_count`` tells. Words need
    an id column, so that equal words on a page stay apart."""
    spans = bands.select(*page_keys, "band_id", F.col("top").alias("_b0"), F.col("bottom").alias("_b1"))
    on = [F.col(f"w.{k}") == F.col(f"b.{k}") for k in page_keys]
    inside = (F.col(f"w.{at}") >= F.col("b._b0")) & (F.col(f"w.{at}") < F.col("b._b1"))
    met = words.alias("w").join(spans.alias("b"), _all([*on, inside]), "left")
    return met.groupBy(*[F.col(f"w.{c}").alias(c) for c in words.columns]).agg(
        F.count("b.band_id").alias("band_count"), F.min("b.band_id").alias("band_id"))


def _all(rules: Sequence[Column]) -> Column:
    result = rules[0]
    for rule in rules[1:]:
        result = result & rule
    return result


def nearest_heading(rows: DataFrame, headings: DataFrame, page_keys: Sequence[str], top: str, tie: str, label: str) -> DataFrame:
    """Heading closest above each row on its page."""
    return as_of_previous(rows, headings, page_keys, top, tie, label, "heading")


def assign_sections(pages: DataFrame, sections: DataFrame, document: str, page: str) -> DataFrame:
    """Section of every page by page range; found by position, not by pairing pages and sections."""
    starts = sections.select(document, F.col("first_page").alias(page), F.col("section").alias("tie"),
                             F.struct("section", "pages", "first_page").alias("entry"))
    placed = as_of_previous(pages.withColumn("tie", F.lit(None).cast(sections.schema["section"].dataType)), starts, [document], page, "tie", "entry", "_s")
    entry = F.col("_s.value")
    return placed.withColumn("section", F.when(F.col(page) < entry["first_page"] + entry["pages"], entry["section"])).drop("_s", "tie")


def carry_sections(pages: DataFrame, start: Column, document: str, page: str, like: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """Section of every page as :func:`assign_sections` gives it, where the pages hold the sections themselves: ``start`` is the
    struct (first_page, section, pages) of the section that starts on the page, else null. No second table is made or shuffled.
    A page without document or number is in no section. ``like`` and ``partitions`` as in :func:`ordered_scan`."""
    known = F.col(document).isNotNull() & F.col(page).isNotNull()
    placed = ordered_scan(pages, [document], [F.col(page)], [last_known("_s", F.when(known, start))], like=like, partitions=partitions)
    entry = F.col("_s")
    return placed.withColumn("section", F.when(F.col(page) < entry["first_page"] + entry["pages"], entry["section"])).drop("_s")


def unpivot_marks(rows: DataFrame, identity: Sequence[str], marks: Sequence[str], mark: str = "X") -> DataFrame:
    """Codes of the marked columns, sorted; anything but the mark or a blank is rejected."""
    cells = F.array(*[F.struct(F.lit(c).alias("code"), F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).alias("v")) for c in marks])
    chosen = F.transform(F.filter(cells, lambda s: s["v"] == mark), lambda s: s["code"])
    wrong = F.exists(cells, lambda s: ~s["v"].isin(mark, ""))
    return rows.select(*identity, F.array_sort(chosen).alias("codes"), wrong.alias("rejected"))


def code_counts(rows: DataFrame, codes: str) -> DataFrame:
    """Members per code; members without codes count under null."""
    return rows.select(F.explode_outer(codes).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("members"))


# Printed phrases of appointment notes, in lower case and with single spaces.
DATE_PHRASE = "incorporación al centro adjudicado el"
DATE_FORM = r"\d{2}/\d{2}/(?:\d{4}|\d{2})"
OBSERVATIONS = "observaciones:"
REPLACES = ("sustituye", "a")
MASKED = r"\*+\d+\*+"
STATEMENTS = {"nombramiento provisional": "provisional", "nombramiento definitivo": "definitive"}


def stated_dates(note: Column, general: Column) -> Column:
    """One date for every place where the note speaks of a start date; null where it cannot be read."""
    phrase = r"(?iu)\b" + DATE_PHRASE.replace(" ", r"\s+") + r"\b"
    # A place without a date that can be read gives an empty text, hence null.
    places = F.regexp_extract_all(note, F.lit(rf"{phrase}(?:\s+({DATE_FORM})(?![\d/])\b)?"), F.lit(1))
    century = F.floor(F.year(general) / 100).cast("string")

    def day(text: Column) -> Column:
        year = F.substring(text, F.lit(7), F.lit(4))
        return F.try_to_date(F.concat(F.when(F.length(year) == 2, F.concat(century, year)).otherwise(year), F.lit("-"), F.substring(text, 4, 2), F.lit("-"), F.left(text, F.lit(2))))

    return F.transform(places, day)


def observed_words(note: Column) -> Column:
    """Words after the heading of the observations, without masked replacements and without a start date in front."""
    words = F.filter(F.split(F.lower(F.get(F.split(note, rf"(?iu)\b{OBSERVATIONS}", 2), F.lit(1))), r"\s+"), lambda w: w != "")

    def replacement(words: Column, at: Column) -> Column:
        """Do the three words from ``at`` name a replaced person?"""
        first, second = REPLACES
        return F.coalesce((F.get(words, at) == first) & (F.get(words, at + 1) == second) & F.get(words, at + 2).rlike(f"^{MASKED}$"), F.lit(False))

    told = F.filter(words, lambda w, i: ~(replacement(words, i) | replacement(words, i - 1) | replacement(words, i - 2)))
    lead = len(DATE_PHRASE.split()) + 1
    dated = (F.array_join(F.slice(told, 1, lead - 1), " ") == DATE_PHRASE) & F.coalesce(F.get(told, F.lit(lead - 1)).rlike(rf"^{DATE_FORM}\.?$"), F.lit(False))
    return F.when(dated, F.slice(told, F.lit(lead + 1), F.size(told))).otherwise(told)


def administrative_facts(rows: DataFrame, note: Column, general: Column, reviewed: DataFrame | None = None) -> DataFrame:
    """Add what notes state: ``incorporation_at``, ``date_conflict``, ``appointment_status``, ``status_conflict``.

    All places that speak of a start date must be readable and agree, else ``date_conflict``; without one the general
    date of the publication holds. The observations state a status if they are, as a whole, a ``reviewed`` clause
    (clause, status), or if every sentence is one of STATEMENTS and all agree; anything else, also a negation or
    a request, leaves it unknown. Case and white space do not matter. ``reviewed`` has a clause once; beyond a small
    size it is joined by shuffling.
    """
    days = stated_dates(note, general)
    conflict = F.exists("_days", lambda d: d.isNull()) | (F.size(F.array_distinct("_days")) > 1)
    whole = F.array_join(observed_words(note), " ")
    known = F.create_map(*[F.lit(x) for pair in STATEMENTS.items() for x in pair])
    sentences = F.transform(F.split("_whole", r"\. "), lambda c: F.try_element_at(known, F.regexp_replace(c, r"\.$", "")))
    plain = F.forall("_states", lambda c: c.isNotNull())
    one = F.size(F.array_distinct("_states")) == 1
    read = rows.withColumn("_days", F.coalesce(days, F.array().cast("array<date>"))).withColumn("_whole", F.coalesce(whole, F.lit(""))).withColumn("_states", sentences)
    clause = F.regexp_replace("_whole", r"\.$", "")
    if reviewed is None:
        met = read.withColumn("_reviewed", F.lit(None).cast("string"))
    else:
        told = F.regexp_replace(F.trim(F.regexp_replace(F.lower("clause"), r"\s+", " ")), r"\.$", "")
        listed = small_side(reviewed.select(told.alias("_clause"), F.col("status").alias("_reviewed")))
        met = read.join(listed, clause == F.col("_clause"), "left").drop("_clause")
    return met.withColumns({
        "date_conflict": conflict, "incorporation_at": F.when(~conflict, F.coalesce(F.get("_days", F.lit(0)), general)),
        "appointment_status": F.coalesce("_reviewed", F.when(plain & one, F.get("_states", F.lit(0)))),
        "status_conflict": F.col("_reviewed").isNull() & plain & ~one}).drop("_days", "_whole", "_states", "_reviewed")
