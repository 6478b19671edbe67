import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from pubtrack.operators import extract, scan
from pubtrack.plans import catalog

TITLE = "RELACIÓN DEFINITIVA DEL PERSONAL INTERINO DE SECUNDARIA Y OTROS CUERPOS PARA EL"
LAYOUT = extract.RosterLayout(required=(TITLE, "CURSO 2026/2027"), ignored=("Nº Lista DNI Apellidos, Nombre Puntos",))


def page(number, *rows, title=TITLE):
    return [title, "CURSO 2026/2027", *rows, f"Página {number}"]


HEAD = ["Cuerpo: 0590 PROFESORES", "Especialidad: 001 FILOSOFÍA", "Lista: 1 BLOQUE", "Nº Lista DNI Apellidos, Nombre Puntos"]
GOOD = [["cover"], page(1, *HEAD, "25000010 ***1234** NÚÑEZ, ANA 10.0000"),
        page(2, "25000020 ****1234* LUZ, EVA 9.5000", "Lista: 2 OTRO", "25000010 ***9999** SOL, IGNACIO 1.0000"),
        [TITLE, "EXCLUIDO"]]


def lines(table, pages):
    rows = [("d", p + 1, n, text) for p, texts in enumerate(pages) for n, text in enumerate(texts)]
    return table(rows, "doc string, page int, line_no int, text string")


def test_roster_rows_and_ranks(table):
    members, faults = extract.parse_roster(lines(table, GOOD), LAYOUT)
    rows = members.orderBy("rank").collect()
    assert faults.count() == 0
    assert [(r["rank"], r["page"], r["block"], r["list_number"]) for r in rows] == [(1, 2, "1", "25000010"), (2, 3, "1", "25000020"), (3, 3, "2", "25000010")]
    assert rows[0]["specialty"] == "0590001" and rows[0]["search_name"] == "NUNEZ, ANA"
    assert len({r["id"] for r in rows}) == 3
    assert not [c for c in members.columns if "dni" in c or "points" in c]


@pytest.mark.parametrize("change, problem", [
    (lambda p: p[1].__setitem__(6, "25000010 ***1234** NÚÑEZ ANA"), "unrecognised_line"),
    (lambda p: p[2].__setitem__(-1, "Página 3"), "page_sequence"),
    (lambda p: p[2].__setitem__(2, "25000010 ****1234* LUZ, EVA 9.5000"), "unordered_number"),
    (lambda p: p[2].__setitem__(1, "CURSO 2025/2026"), "page_heading"),
    (lambda p: p.pop(), "no_end_marker"),
    (lambda p: p[1].__setitem__(4, "Especialidad: 002 OTRA"), "no_context"),
])
def test_roster_fails_closed(table, change, problem):
    pages = [list(p) for p in GOOD]
    change(pages)
    faults = extract.parse_roster(lines(table, pages), LAYOUT)[1]
    assert problem in {r["violation"] for r in faults.collect()}


def test_words_become_cells_in_reading_order(table):
    words = table([("d", 1, 0, 10.0, 5.0, "IES"), ("d", 1, 0, 20.0, 5.2, "LUZ"), ("d", 1, 0, 12.0, 9.0, "NORTE"), ("d", 1, 0, 60.0, 5.0, "VP")],
                  "doc string, page int, band int, x0 double, top double, text string")
    columns = [("center", 0.0, 50.0), ("quota", 50.0, 99.0)]
    cells = {r["label"]: r["cell"] for r in extract.words_to_cells(words, columns, ["doc", "page"], "band").collect()}
    assert cells == {"center": "IES LUZ NORTE", "quota": "VP"}


def test_band_must_be_unique(table):
    words = table([("d", "w1", 5.0), ("d", "w2", 25.0), ("d", "w3", 99.0)], "doc string, w string, y double")
    bands = table([("d", 1, 0.0, 10.0), ("d", 2, 20.0, 30.0), ("d", 3, 24.0, 40.0)], "doc string, band_id int, top double, bottom double")
    got = {r["w"]: r["band_count"] for r in extract.words_to_bands(words, bands, ["doc"], "y").collect()}
    assert got == {"w1": 1, "w2": 2, "w3": 0}


def test_facts_only_from_plain_statements(table):
    general = datetime.date(2026, 9, 1)
    notes = [
        ("INCORPORACIÓN AL CENTRO ADJUDICADO EL 03/10/26 y luego", datetime.date(2026, 10, 3), None, False),
        ("OBSERVACIONES: Nombramiento provisional.", general, "provisional", False),
        ("OBSERVACIONES: No procede nombramiento definitivo", general, None, False),
        ("Incorporación al centro adjudicado el 03/10/2026 Incorporación al centro adjudicado el 04/10/2026", None, None, True),
        ("Incorporación al centro adjudicado el 31/02/2026", None, None, True),
        ("Incorporación al centro adjudicado el 03/10/2026 y al centro. INCORPORACIÓN  AL CENTRO ADJUDICADO EL lunes", None, None, True),
        ("OBSERVACIONES: incorporación al centro adjudicado el 03/10/26. Nombramiento Sustituye a **12* definitivo", datetime.date(2026, 10, 3), "definitive", False),
        ("OBSERVACIONES: Nombramiento definitivo. Nombramiento Definitivo", general, "definitive", False),
        ("OBSERVACIONES: Nombramiento definitivo. Nombramiento provisional", general, None, False),
        ("Otra cosa OBSERVACIONES:  plaza de  URGENCIA, art. 3.", general, "provisional", False),
        ("Plaza de urgencia, art. 3", general, None, False), ("", general, None, False), (None, general, None, False),
    ]
    frame = table([(i, n[0]) for i, n in enumerate(notes)], "i int, note string")
    reviewed = table([("Plaza de urgencia, art. 3", "provisional")], "clause string, status string")
    facts = extract.administrative_facts(frame, F.col("note"), F.lit("2026-09-01").cast("date"), reviewed).collect()
    assert len(facts) == len(notes) and [r["i"] for r in facts if r["status_conflict"]] == [8]
    for row in facts:
        _, start, status, conflict = notes[row["i"]]
        assert (row["incorporation_at"], row["appointment_status"], row["date_conflict"]) == (start, status, conflict)


def test_sections_come_from_the_range_before(table):
    pages = table([("d", p) for p in range(1, 7)], "doc string, page int")
    sections = table([("d", 1, 2, "a"), ("d", 4, 2, "b")], "doc string, first_page int, pages int, section string")
    got = {r["page"]: r["section"] for r in extract.assign_sections(pages, sections, "doc", "page").collect()}
    assert got == {1: "a", 2: "a", 3: None, 4: "b", 5: "b", 6: None}


def test_marks(table):
    rows = table([(1, "X", "", " X "), (2, None, "x", None)], "id int, a string, b string, c string")
    got = {r["id"]: (r["codes"], r["rejected"]) for r in extract.unpivot_marks(rows, ["id"], ["a", "b", "c"]).collect()}
    assert got == {1: (["a", "c"], False), 2: ([], True)}


def test_sections_on_their_pages(spark, table, tmp_path):
    rows = [(1, 1, 9, 5.0, "A"), (1, 1, 7, 25.0, "A"), (1, 2, 5, 1.0, "R"), (1, 3, 5, 1.0, "R"), (2, 1, 1, 1.0, "R"), (2, 2, 4, None, "A"), (2, 3, 4, 50.0, "A"), (2, 4, 4, 9.0, None),
            (2, 6, 4, 9.0, "R"), (2, 7, 4, 9.0, "R"), (None, 1, 3, 50.0, "A"), (None, 2, 3, 50.0, "R"), (3, None, 8, 50.0, "A"), (3, 1, 8, 50.0, "R")]
    lines = table(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_returnflag string")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.QUERIES["page_sections"](spark, str(tmp_path))
    # A page without document or number is in no section, and starts none, as in the SQL.
    want = {(1, 1, 7), (1, 2, None), (1, 3, None), (2, 1, None), (2, 2, None), (2, 3, 4), (2, 4, 4), (2, 6, None), (2, 7, None), (None, 1, None), (None, 2, None),
            (3, None, None), (3, 1, None)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    sql = duckdb.sql(catalog.ORACLES["page_sections"].replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet/*.parquet'")).fetchall()
    assert set(sql) == want and len(sql) == len(want)


def test_section_pages_follow_the_size_of_the_table(spark, monkeypatch):
    monkeypatch.setattr(scan, "PARTITION_BYTES", 1 << 10)
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    many = scan.partitions_for(lines)
    assert many > 4
    plan = catalog.QUERIES["page_sections"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_key#" in plan and f", {many}), REPARTITION_BY_NUM" in plan
