from pyspark.sql import functions as F

from pubtrack.functions.values import any_date, clean_count, clean_number, clean_stamp, local_instant
from pubtrack.operators import validate

CELLS = ["30099887 IES ARROYO CLARO", "VILLA DE ARRIBA", "0590F21 DIBUJO TECNICO / FRANCES", "VS", "N", "Completa", "1"]


def with_cell(i, value):
    return [value if j == i else c for j, c in enumerate(CELLS)]


def test_vacancy_rules(table):
    cases = [(CELLS, []), (with_cell(0, "20099887 IES"), ["center_code"]), (with_cell(2, "0490I06 X"), ["function_code"]), (with_cell(2, "0594B23 PIANO"), []),
             (with_cell(3, "VX"), ["quota"]), (with_cell(4, "X"), ["itinerant"]), (with_cell(5, "Tiempo Parcial 41 horas"), ["workload"]),
             (with_cell(5, "Tiempo Parcial 12 horas"), []), (with_cell(6, "0"), ["quantity"]), (CELLS[:6], None), (with_cell(1, "  "), ["empty_cell"])]
    frame = table([(i, c[0]) for i, c in enumerate(cases)], "i int, cells array<string>")
    for row in validate.with_violations(frame, validate.vacancy_rules(F.col("cells"))).collect():
        expected = cases[row["i"]][1]
        assert row["violations"] == expected if expected is not None else "cell_count" in row["violations"]


def test_typed_row(table):
    rows = table([("d", 1, 2, CELLS), ("d", 1, 3, with_cell(5, "Tiempo Parcial 9 horas"))], "doc string, page int, row_number int, cells array<string>")
    first, second = validate.typed_vacancy(rows, "cells", "doc", "page", "row_number").orderBy("row_number").collect()
    assert (first["id"], first["center_code"], first["function_code"], first["body"], first["language"]) == ("d:1:2", "30099887", "0590F21", "Secundaria", "Francés")
    assert (first["workload"], first["hours"], second["workload"], second["hours"]) == ("full", None, "partial", 9)


def test_cell_boxes(table):
    edges = validate.COLUMN_EDGES
    good = [[float(a), 10.0, float(b), 20.0] for a, b in zip(edges, edges[1:])]
    shifted = [list(b) for b in good]
    shifted[3][0] += 5
    tall = [list(b) for b in good]
    tall[2][3] = 40.0
    frame = table([(0, good), (1, shifted), (2, tall), (3, good[:6])], "i int, boxes array<array<double>>")
    found = {r["i"]: r["violations"] for r in validate.with_violations(frame, validate.box_rules(F.col("boxes"))).collect()}
    assert found[0] == [] and found[1] == ["box_columns"] and found[2] == ["box_row"] and "box_count" in found[3]


def test_daylight_saving_is_refused(table):
    frame = table([("2026-03-29 02:30:00",), ("2026-10-25 02:30:00",), ("2026-07-01 12:00:00",), ("2026-01-01 12:00:00",)], "t string")
    got = [r[0] for r in frame.select(F.date_format(local_instant(F.col("t").cast("timestamp")), "yyyy-MM-dd HH:mm")).collect()]
    assert got == [None, None, "2026-07-01 10:00", "2026-01-01 11:00"]


def test_page_header(table):
    head = "Listado de Vacantes Sin Cubrir de Secundaria\nConvocatoria: Adjudicación semanal {} . Proceso 3133 - Listado a 30 de septiembre de 2026, a las {}\nPágina 1 de 2"
    head = head.replace(" . ", ". ")
    frame = table([(0, head.format("01/10/2026", "10:00")), (1, head.format("30/09/2026", "10:00")), (2, head.format("30/09/2026", "10:00").replace("1 de 2", "2 de 2"))], "i int, text string")
    pages = frame.withColumn("page", F.lit(1)).withColumn("page_count", F.lit(2))
    found = {r["i"]: (r["violations"], r["process_id"]) for r in validate.page_headers(pages, "text", "page", "page_count").collect()}
    assert found == {0: (["act_date"], "3133"), 1: ([], "3133"), 2: (["footer"], "3133")}


def test_gates(table):
    ranks = table([("a", 1), ("a", 2), ("b", 1), ("b", 3), ("c", 1), ("c", 1), ("c", None)], "s string, rank int")
    assert {r["s"]: r["complete"] for r in validate.rank_completeness(ranks, ["s"], "rank").collect()} == {"a": True, "b": False, "c": False}
    sections = table([("x", 1, 2, 4), ("x", 3, 2, 4), ("y", 1, 2, 4), ("y", 4, 1, 4), ("z", 1, 3, 4)], "d string, first_page int, pages int, page_count int")
    got = {r["d"]: r["complete"] for r in validate.section_coverage(sections, "d", "first_page", "pages", "page_count").collect()}
    assert got == {"x": True, "y": False, "z": False}
    gate = validate.manifest_gate(table([("a", 1), ("b", 2)], "k string, n int"), table([("a", 1), ("c", 2)], "k string, e int"), ["k"], "n", "e")
    assert {r["k"]: r["matches"] for r in gate.collect()} == {"a": True, "b": False, "c": False}


def test_sanitizers(table):
    frame = table([("2026-10-01T10:00:00+02:00",), ("2026-10-01T10:00:00",), ("x" * 50,), (None,), ("12",), ("-1",), ("99999999",), ("1e12",)], "v string")
    rows = frame.select(clean_stamp(F.col("v")), clean_count(F.col("v")), clean_number(F.col("v"))).collect()
    assert rows[0][0] is not None and all(r[0] is None for r in rows[1:])
    assert [r[1] for r in rows] == [0, 0, 0, 0, 12, 0, 0, 0]
    assert rows[4][2] == 12.0 and rows[5][2] is None and rows[7][2] is None
    dates = table([("2026-10-02",), ("2026-02-30",), ("Fri, 02 Oct 2026 08:00:00 +0200",), ("Listado de 02/10/2026",), ("nada",)], "v string")
    assert [r[0] for r in dates.select(any_date(F.col("v"))).collect()] == ["2026-10-02", None, "2026-10-02T06:00:00Z", "2026-10-02", None]
