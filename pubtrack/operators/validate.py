"""Fail-closed validation: rule columns, manifest reconciliation and completeness gates.

Rules never drop rows. ``with_violations`` attaches the list of broken rules; ``split`` gives the
accepted and the rejected part; gates compare totals with an independent manifest.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubtrack.functions.text import squeeze
from pubtrack.functions.urls import url_part
from pubtrack.functions.values import clean_stamp, local_instant, strict_date
from pubtrack.operators.scan import following, ordered_scan, previous
from pubtrack.session import small_side


def with_violations(rows: DataFrame, rules: Mapping[str, Column], name: str = "violations") -> DataFrame:
    """Array of the names of the rules a row breaks; an undecidable rule counts as broken."""
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(label)) for label, rule in rules.items()]
    return rows.withColumn(name, F.array_compact(F.array(*broken)))


def split(rows: DataFrame, name: str = "violations") -> tuple[DataFrame, DataFrame]:
    """Accepted rows and quarantined rows."""
    return rows.where(F.size(name) == 0).drop(name), rows.where(F.size(name) > 0)


def each_violation(rows: DataFrame, columns: Sequence[str], name: str = "violations") -> DataFrame:
    """One row (columns, rule) for every broken rule. For an inner ``explode`` Spark infers a filter on the array and pushes
    it to the scan, where all rules and what they read are written out and computed once more for every use."""
    return rows.select(*columns, F.explode_outer(name).alias("rule")).where("rule IS NOT NULL")


def violation_counts(rows: DataFrame, group: Sequence[str], name: str = "violations") -> DataFrame:
    """How often each rule is broken per group."""
    return each_violation(rows, group, name).groupBy(*group, "rule").agg(
        F.count(F.lit(1)).alias("row_count"))


def publication_gate(rows: DataFrame, publication: Sequence[str], name: str = "violations") -> DataFrame:
    """A publication is accepted whole or not at all."""
    return rows.groupBy(*publication).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(F.size(name) > 0).alias("broken_rows"),
        (F.count_if(F.size(name) > 0) == 0).alias("accepted"))


# Closed code lists of vacancy rows.
QUOTAS = ["VP", "VS"]
ITINERANT = ["N", "S"]
BODIES = {
    "0590": "Secundaria", "0592": "Escuelas oficiales de idiomas",
    "0593": "Catedráticos de música y artes escénicas", "0594": "Música y artes escénicas",
    "0596": "Maestros de taller de artes plásticas", "0598": "Sectores singulares de FP",
}
LANGUAGES = {"A": "Alemán", "F": "Francés", "I": "Inglés"}
# Left edges and right limit of the seven columns of the reviewed page layout.
COLUMN_EDGES = [35, 285, 373, 638, 668, 688, 770, 824]


def workload(label: Column) -> tuple[Column, Column]:
    """Workload kind and weekly hours: ``Completa`` or ``Tiempo Parcial 1..40 horas``."""
    hours = F.regexp_extract(label, r"^Tiempo Parcial ([1-9]\d?) horas$", 1).try_cast("int")
    kind = F.when(label == "Completa", "full").when(hours.between(1, 40), "partial")
    return kind, F.when(label == "Completa", F.lit(None).cast("int")).otherwise(F.when(hours.between(1, 40), hours))


def vacancy_rules(cells: Column) -> dict[str, Column]:
    """Rules for the seven cells of a vacancy row."""
    cell = [squeeze(F.get(cells, F.lit(i))) for i in range(7)]
    function = r"^(?:05\d{2}(?:\d{3}|[AFI]\d{2})|0594B23) \S.*$"
    return {
        "cell_count": F.size(cells) == 7,
        "empty_cell": F.forall(cells, lambda c: c.isNotNull() & (squeeze(c) != "")),
        "control_character": F.forall(cells, lambda c: ~F.rlike(c, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"))),
        "center_code": F.rlike(cell[0], F.lit(r"^30\d{6} \S.*$")),
        "function_code": F.rlike(cell[2], F.lit(function)),
        "quota": cell[3].isin(QUOTAS),
        "itinerant": cell[4].isin(ITINERANT),
        "workload": workload(cell[5])[0].isNotNull(),
        "quantity": F.rlike(cell[6], F.lit(r"^[1-9]\d{0,2}$")),
    }


def box_rules(boxes: Column, page_height: float = 595.0) -> dict[str, Column]:
    """Rules for the seven cell rectangles ``[x0, top, x1, bottom]`` of one row."""
    left, right = COLUMN_EDGES[:-1], COLUMN_EDGES[1:]
    edges = F.array(*[F.struct(F.lit(a).alias("x0"), F.lit(b).alias("x1")) for a, b in zip(left, right)])

    def at(box: Column, i: int) -> Column:
        return F.get(box, F.lit(i))

    aligned = F.forall(F.arrays_zip(boxes.alias("box"), edges.alias("edge")), lambda z: (
        (F.abs(at(z["box"], 0) - z["edge"]["x0"]) <= 2) & (F.abs(at(z["box"], 2) - z["edge"]["x1"]) <= 2)))
    first = F.get(boxes, F.lit(0))
    return {
        "box_count": F.size(boxes) == 7,
        "box_shape": F.forall(boxes, lambda b: (F.size(b) == 4) & F.forall(
            b, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e308))),
        "box_range": F.forall(boxes, lambda b: (at(b, 2) > at(b, 0)) & (at(b, 3) > at(b, 1)) & (at(b, 1) >= 0) & (at(b, 3) <= page_height)),
        "box_columns": aligned,
        "box_row": F.forall(boxes, lambda b: (F.abs(at(b, 1) - at(first, 1)) <= 1) & (F.abs(at(b, 3) - at(first, 3)) <= 1)),
    }


# Forms of identifiers, numbers and codes in published records.
RECORD_ID, LIST_NUMBER, SPECIALTY_CODE = "^[a-f0-9]{32}$", r"^\d{7,8}$", "^03[1-9]$"
PRINTED_CODE = "^(?:03[1-9]|59703[1-9]|059703[1-9])$"
CODE_PREFIXES = ("597", "0597")
BLOCKS = ["I", "II"]
CODE_STATES = ["published", "not_stated"]
RELATIONS = ["inclusion", "habilitation_added"]
MOST_CODES = 100


def readable(text: Column, most: int = 180) -> Column:
    """Neither empty nor too long, and without control characters."""
    return F.length(text).between(1, most) & ~F.rlike(text, F.lit(r"[\x00-\x1f]"))


def page_inside(page: Column, pages: Column, first: int = 1) -> Column:
    return (page >= first) & (page <= pages)


def record_rules() -> dict[str, Column]:
    """Rules for the records of a ranked list. Columns: id, membership_id, list_number, name, rank, block, block_name, page,
    baseline_page, roster_id, source_id, codes (array of struct code, name), codes_state and relation (struct kind,
    previous_id, previous_number, source, page, code, printed); besides what :func:`with_documents` adds.

    A row comes from its roster or from one of its amendments, and its page must exist there. Codes are told apart by
    their last three digits. A relation exists only in rows of an amendment: an inclusion names nobody before, an added
    code names the same member at the stated place of the roster, and the member must hold the code.
    """
    r = F.col("relation")
    optional = lambda value, rule: value.isNull() | F.coalesce(rule, F.lit(False))
    tails = F.transform("codes", lambda c: F.right(c["code"], F.lit(3)))
    state = F.coalesce("codes_state", F.when(F.size("codes") > 0, "published").otherwise("not_stated"))
    included = r["previous_id"].isNull() & r["previous_number"].isNull()
    added = ((r["previous_id"] == F.col("id")) & (r["previous_number"] == F.col("list_number")) & (r["source"] == F.col("roster_id"))
             & page_inside(r["page"], F.col("roster_pages")) & (r["page"] == F.col("baseline_page")) & F.rlike(r["code"], F.lit(SPECIALTY_CODE))
             & F.exists("codes", lambda c: c["code"] == r["code"]) & r["printed"].isin(*[F.concat(F.lit(p), r["code"]) for p in CODE_PREFIXES]))
    stated = F.col("amendment_pages").isNotNull() & r["kind"].isin(RELATIONS) & F.when(r["kind"] == "inclusion", included).otherwise(added)
    return {
        "identity": F.rlike("id", F.lit(RECORD_ID)) & optional(F.col("membership_id"), F.rlike("membership_id", F.lit(RECORD_ID))),
        "source": F.col("roster_pages").isNotNull() & ((F.col("source_id") == F.col("roster_id")) | F.col("amendment_pages").isNotNull()),
        "list_number": F.rlike("list_number", F.lit(LIST_NUMBER)),
        "text": readable(F.col("name")) & readable(F.col("block_name")),
        "block": F.col("block").isin(BLOCKS),
        "rank": page_inside(F.col("rank"), F.col("roster_count")),
        "page": page_inside(F.col("page"), F.coalesce("amendment_pages", "roster_pages")),
        "baseline_page": optional(F.col("baseline_page"), page_inside(F.col("baseline_page"), F.col("roster_pages"))),
        "codes": (F.size("codes") <= MOST_CODES) & F.forall("codes", lambda c: F.rlike(c["code"], F.lit(PRINTED_CODE)) & readable(c["name"])) & (F.size(F.array_distinct(tails)) == F.size("codes")),
        "codes_state": state.isin(CODE_STATES) & ((state == "published") | (F.size("codes") == 0)),
        "relation": optional(r, stated),
    }


def with_documents(records: DataFrame, rosters: DataFrame, amendments: DataFrame) -> DataFrame:
    """Add ``roster_pages``, ``roster_count`` and ``amendment_pages`` (null where there is none) from the published rosters
    (roster_id, pages, members) and amendments (roster_id, source_id, pages): lists of documents, far smaller than their rows."""
    listed = rosters.select("roster_id", F.col("pages").alias("roster_pages"), F.col("members").alias("roster_count"))
    amended = amendments.select("roster_id", "source_id", F.col("pages").alias("amendment_pages"))
    return records.join(small_side(listed), "roster_id", "left").join(small_side(amended), ["roster_id", "source_id"], "left")


def record_violations(records: DataFrame, rosters: DataFrame, amendments: DataFrame, name: str = "violations") -> DataFrame:
    """The records with the names of the rules they break; an undecidable rule counts as broken."""
    checked = with_violations(with_documents(records, rosters, amendments), record_rules(), name)
    return checked.drop("roster_pages", "roster_count", "amendment_pages")


def typed_vacancy(rows: DataFrame, cells: str, document: str, page: str, row_number: str) -> DataFrame:
    """Typed columns of validated vacancy cells, next to the untouched originals."""
    cell = [squeeze(F.get(F.col(cells), F.lit(i))) for i in range(7)]
    code = F.get(F.split(cell[2], " ", 2), F.lit(0))
    body = F.substring(code, 1, 4)
    kind, hours = workload(cell[5])
    return rows.select(
        F.concat_ws(":", document, page, row_number).alias("id"), document, page, row_number,
        F.get(F.split(cell[0], " ", 2), F.lit(0)).alias("center_code"), F.get(F.split(cell[0], " ", 2), F.lit(1)).alias("center"),
        cell[1].alias("municipality"), code.alias("function_code"), F.get(F.split(cell[2], " ", 2), F.lit(1)).alias("function"),
        body.alias("body_code"), lookup(body, BODIES, "Otros cuerpos").alias("body"),
        cell[3].alias("cupo"), cell[4].alias("itinerant"), cell[5].alias("jornada"), kind.alias("workload"),
        hours.alias("hours"), cell[6].cast("int").alias("quantity"),
        lookup(F.substring(code, 5, 1), LANGUAGES, "Sin mención bilingüe").alias("language"),
        F.col(cells).alias("raw_cells"))


def lookup(value: Column, table: Mapping[str, str], default: str) -> Column:
    """Closed code list with a default label."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, value), F.lit(default))


def manifest_gate(counts: DataFrame, manifest: DataFrame, keys: Sequence[str], count: str, expected: str) -> DataFrame:
    """Observed against expected totals; a key on one side only is a mismatch."""
    met = counts.select(*keys, count).join(manifest.select(*keys, expected), list(keys), "full")
    return met.withColumn("matches", F.col(count).eqNullSafe(F.col(expected)))


def rank_completeness(rows: DataFrame, scope: Sequence[str], rank: str) -> DataFrame:
    """Ranks 1..n without gaps or repeats per scope. Repeats are counted in two map-side
    combined steps, so that one large scope is never held in one task."""
    ranked = rows.where(F.col(rank).isNotNull())
    per_rank = ranked.groupBy(*scope, rank).agg(F.count(F.lit(1)).alias("_n"))
    stats = per_rank.groupBy(*scope).agg(
        F.sum("_n").alias("ranked"), F.min(rank).alias("first_rank"), F.max(rank).alias("last_rank"),
        F.count_if(F.col("_n") > 1).alias("repeated_ranks"))
    whole = (F.col("first_rank") == 1) & (F.col("last_rank") == F.col("ranked")) & (F.col("repeated_ranks") == 0)
    return stats.withColumn("complete", whole)


def duplicate_ranks(rows: DataFrame, scope: Sequence[str], rank: str) -> DataFrame:
    """Ranks used more than once inside a scope."""
    return (rows.where(F.col(rank).isNotNull()).groupBy(*scope, rank).agg(F.count(F.lit(1)).alias("copies"))
            .where(F.col("copies") > 1))


def evidence_counts(rows: DataFrame, rank: str, keys: Sequence[str]) -> DataFrame:
    """Rows without a rank (awards) per source and specialty."""
    return rows.where(F.col(rank).isNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("record_count"))


def section_coverage(sections: DataFrame, document: str, first_page: str, pages: str, page_count: str) -> DataFrame:
    """Page ranges per document: contiguous from page 1, without overlap, up to the last page."""
    end = F.col(first_page) + F.col(pages)
    scanned = ordered_scan(sections, [document], [F.col(first_page), end],
                           [previous("_expected", end), following("_next", F.col(first_page))])
    contiguous = F.col(first_page) == F.coalesce("_expected", F.lit(1))
    return scanned.groupBy(document).agg(
        F.count_if(~contiguous).alias("gaps"), (F.max(end) - 1).alias("last_page"),
        F.max(page_count).alias("page_count"),
        ((F.count_if(~contiguous) == 0) & (F.max(end) - 1 == F.max(page_count))).alias("complete"))


def unique_key_gate(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; the gate passes when this is empty."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


# Month names and printed header of a vacancy publication.
MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
VACANCY_TITLE = "Listado de Vacantes Sin Cubrir de Secundaria"
NOTICE = (r"Convocatoria: (Adjudicación semanal) (\d{2}/\d{2}/\d{4})\. Proceso ([1-9]\d{0,9}) - "
          r"Listado a (\d{1,2}) de ([A-Za-záéíóú]+) de (\d{4}), a las (\d{2}:\d{2})")


def page_headers(pages: DataFrame, text: str, page: str, page_count: str) -> DataFrame:
    """Parsed header of every page and the rules it breaks. The issue time is local; a clock time that
    daylight saving skips or repeats is refused rather than guessed."""
    lines = F.split(F.col(text), "\n")
    notice = F.get(lines, F.lit(1))

    def part(group: int) -> Column:
        return F.regexp_extract(notice, f"^{NOTICE}$", group)

    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(part(5)))
    clock = F.concat(part(6), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(part(4), 2, "0"), F.lit(" "), part(7), F.lit(":00"))
    local = F.try_to_timestamp(F.when(month > 0, clock), F.lit("yyyy-MM-dd HH:mm:ss"))
    act = F.try_to_date(F.nullif(part(2), F.lit("")), "dd/MM/yyyy")
    footer = F.concat(F.lit("Página "), F.col(page).cast("string"), F.lit(" de "), F.col(page_count).cast("string"))
    parsed = pages.withColumn("act_title", F.nullif(part(1), F.lit(""))).withColumn("act_date", act).withColumn(
        "process_id", F.nullif(part(3), F.lit(""))).withColumn("document_issued_at", local_instant(local))
    return with_violations(parsed, {
        "title": F.get(lines, F.lit(0)) == VACANCY_TITLE,
        "notice": F.rlike(notice, F.lit(f"^{NOTICE}$")),
        "footer": (F.element_at(lines, -1) == footer) & (F.regexp_count(F.col(text), F.lit(r"Página \d+ de \d+")) == 1),
        "issue_time": F.col("document_issued_at").isNotNull(),
        "act_date": F.col("act_date").isNotNull() & (F.col("act_date") <= F.to_date(local)),
    })


# How an original may reach the intake and what it may be.
RECEIVED_VIA = ["official_download", "local_file"]
KINDS = ["award", "optan_observation", "maestros_roster", "maestros_correction"]


def download_address(url: Column, host: str, path: str, key: str, value: Column) -> Column:
    """A plain https address of ``host`` and ``path`` whose query names ``value`` under ``key``, once."""
    named = F.filter(F.split(url_part(url, "query"), "&"), lambda p: F.startswith(p, F.lit(key + "=")))
    return ((F.length(url) <= 4096) & ~F.rlike(url, F.lit(r"[\x00-\x1f\\]")) & (F.lower(url_part(url, "scheme")) == "https") & (url_part(url, "authority") == host)
            & (url_part(url, "path") == path) & (url_part(url, "fragment") == "") & (F.size(named) == 1) & (F.get(named, F.lit(0)) == F.concat(F.lit(key + "="), value)))


def intake_rules(host: str, path: str, key: str) -> dict[str, Column]:
    """Rules of an intake request; ``host``, ``path`` and ``key`` describe the official download address."""
    return {
        "content_id": F.rlike("content_id", F.lit(r"^[0-9]{1,12}$")),
        "source_url": download_address(F.col("source_url"), host, path, key, F.col("content_id")),
        "sha256": F.rlike("sha256", F.lit("^[0-9a-f]{64}$")),
        "kind": F.col("kind").isin(KINDS),
        "received_via": F.col("received_via").isin(RECEIVED_VIA),
        "published_at": strict_date(F.col("published_at")).isNotNull(),
        "received_at": clean_stamp(F.col("received_at")).isNotNull(),
        "human_seconds": F.coalesce(F.col("human_seconds").cast("double"), F.lit(0.0)).between(0, 86_400) & (F.coalesce(F.col("human_seconds").cast("double"), F.lit(0.0)) % 1 == 0),
    }
