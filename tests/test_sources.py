import hashlib
import json

import pytest
from pyspark.sql import functions as F

from pubtrack.functions import urls
from pubtrack.sources import sinks, state, web


def test_state_is_split_into_tables(spark, tmp_path):
    row = {"id": "d:1:1", "center_code": "30011764", "quantity": 2}
    document = {"id": "a" * 64, "sha256": "a" * 64, "published_at": "2026-09-30T08:00:00+00:00", "row_count": 1, "places": 2, "status": "approved", "rows": [row]}
    bad = {**document, "id": "zz", "row_count": -1, "published_at": "2026-09-30T08:00:00", "rows": []}
    payload = {"documents": [document, bad], "catalog": {"notices": [{"id": "n", "url": "u"}], "checks": [{"id": "c", "success": True}]}}
    (tmp_path / "state.json").write_text(json.dumps(payload))
    tables = state.read_state(spark, str(tmp_path / "state.json"))
    assert {k: v.count() for k, v in tables.items()} == {"publications": 2, "rows": 1, "notices": 1, "checks": 1}
    problems = {(r["id"], r["problem"]) for r in state.state_problems(tables).collect()}
    assert problems == {("zz", "document_id"), ("zz", "row_count"), ("zz", "published_at")}


def test_manifest_flags_are_inherited(spark, tmp_path):
    manifest = {"content_id": "1", "sha256": "s", "amendments": [{"content_id": "2", "sha256": "s", "kind": "correction"}],
                "documents": [{"content_id": "3", "kind": "award", "incorporated": True, "amendments": [{"content_id": "4", "kind": "correction"}]},
                              {"content_id": "5", "kind": "x", "observation_only": True, "amendments": [{"content_id": "6"}]}, {"content_id": "3", "kind": "award"}],
                "references": [{"content_id": "7"}], "observations": [{"content_id": "8"}]}
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    frame = spark.read.schema(state.MANIFEST).option("multiLine", True).json(str(tmp_path / "m.json"))
    flat = {r["content_id"]: (r["origin"], r["incorporated"], r["observation_only"]) for r in state.flatten_manifest(frame).where("content_id <> '3'").collect()}
    assert flat["4"] == ("amendment", True, False) and flat["6"] == ("amendment", False, True) and flat["2"][1] and flat["8"][2]
    required, repeated = state.required_documents(frame)
    assert sorted(r["content_id"] for r in required.collect()) == ["1", "2", "3", "3", "4"]
    assert [r["content_id"] for r in repeated.collect()] == ["3"]


def test_stored_originals_are_verified(spark, tmp_path):
    good = b"%PDF-1.7 x"
    (tmp_path / (hashlib.sha256(good).hexdigest() + ".pdf")).write_bytes(good)
    (tmp_path / ("0" * 64 + ".pdf")).write_bytes(b"altered")
    got = {r["sha256"]: r["verified"] for r in state.stored_originals(spark, str(tmp_path)).collect()}
    assert got == {hashlib.sha256(good).hexdigest(): True, "0" * 64: False}


def test_run_log_is_tolerant(table):
    run = {"run_id": "r1", "trigger": "alien", "started_at": "2026-10-01T00:17:00Z", "elapsed_seconds": 0.25, "status": "weird",
           "phases": {"vacancies": {"status": "success", "exit_code": 300, "started_at": "x"}}}
    runs, phases = state.read_runs(table([(json.dumps(run),), ("not json",)], "p string"), "p")
    first = runs.where("run_id = 'r1'").first()
    assert (first["trigger"], first["status"], first["elapsed_seconds"]) == ("unknown", "failed", 0.25) and first["started_at"] is not None
    phase = phases.first()
    assert (phase["phase"], phase["status"], phase["exit_code"], phase["started_at"]) == ("vacancies", "success", None, None)


def test_links_and_dates(table):
    html = """<meta property="article:published_time" content="2026-09-30T08:00:00+00:00"><time datetime="2026-09-30">x</time>
      <a class="x" href="/a.pdf?x=1&amp;y=2">Uno <b>dos</b></a><a href='b/c.PDF'>t</a><a href="//h.es/d">u</a><a href="?q=1">v</a>"""
    pages = table([(1, "https://h.es/p/i.html?z#f", html), (2, "https://h.es/", html.replace('time datetime="2026-09-30"', 'time datetime="2026-09-29"'))], "id int, url string, html string")
    got = [(r["link"], r["label"], r["target"]) for r in web.page_links(pages.where("id=1"), "id", "url", "html").orderBy("position").collect()]
    assert got == [("/a.pdf?x=1&y=2", "Uno dos", "https://h.es/a.pdf?x=1&y=2"), ("b/c.PDF", "t", "https://h.es/p/b/c.PDF"), ("//h.es/d", "u", "https://h.es/d"), ("?q=1", "v", "https://h.es/p/i.html?q=1")]
    assert [str(r[0]) for r in pages.orderBy("id").select(web.published_date(F.col("html"))).collect()] == ["2026-09-30", "None"]
    assert web.document_links(web.page_links(pages.where("id=1"), "id", "url", "html"), ["h.es"]).count() == 2


def test_url_rules(table):
    cases = [("https://www.x.es/web/descarga?ID=12", True), ("https://u@www.x.es/web/descarga?ID=12", False), ("https://www.x.es:8443/web/descarga?ID=12", False),
             ("https://www.x.es/web/descarga?ID=1&ID=2", False), ("https://www.x.es/otra?ID=1", False), ("ftp://www.x.es/web/descarga?ID=1", False), ("https://evil.es/web/descarga?ID=1", False)]
    frame = table([(i, c[0]) for i, c in enumerate(cases)], "i int, url string")
    rule = urls.allowed_url(F.col("url"), ["www.x.es"], path="/web/descarga", numeric_key="ID")
    assert [r[0] for r in frame.orderBy("i").select(rule).collect()] == [c[1] for c in cases]
    same = table([("HTTPS://WWW.X.es/p?b=2&a=1#f",), ("https://www.x.es/p?a=1&b=2",)], "url string").select(urls.canonical_url(F.col("url"))).distinct()
    assert same.count() == 1


def test_titles(table):
    cases = {"Resolución definitiva de adjudicación": "award", "Listado provisional": "provisional", "Relación provisional y definitiva": "unclassified",
             "Corrección de errores": "correction", "Lista definitiva de interinos": "baseline", "Se declara desierto": "closed_procedure", "Ceses y bajas": "cessation", "Otra cosa": "unclassified"}
    frame = table([(t,) for t in cases], "t string")
    assert {r["t"]: r["k"] for r in frame.withColumn("k", web.classify_title(F.col("t"))).collect()} == cases
    assert frame.sparkSession.range(1).select(web.is_vacancy_title(F.lit("Relación de Vacantes Sin Cubrir de Secundaria y otros-cuerpos"))).first()[0]


def test_csv_file_is_safe(spark, table, tmp_path):
    rows = table([(1, "=SUM(A1)", 'say "x"'), (2, "  @cmd", None), (3, "plain", "a;b")], "id int, a string, b string")
    sinks.write_csv(rows, [("a", "Uno"), ("b", "Dos")], [F.col("id")], str(tmp_path / "csv"))
    text = "".join(p.read_bytes().decode("utf-8") for p in sorted((tmp_path / "csv").glob("part-*.csv")))
    lines = [l for l in text.split("\r\n") if l and "Uno" not in l]
    assert text.startswith('﻿"Uno";"Dos"\r\n')
    assert sorted(lines) == sorted(['"\'=SUM(A1)";"say ""x"""', '"\'  @cmd";""', '"plain";"a;b"'])


def test_append_is_idempotent_and_export_points_last(spark, table, tmp_path):
    rows = table([("h1", 1), ("h1", 2), ("h2", 3)], "sha256 string, doc long")
    path = str(tmp_path / "archive")
    for _ in range(2):
        sinks.append_content(rows, path, "sha256", "doc")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("h1", 1), ("h2", 3)]
    sinks.export({"docs": (rows, ["sha256"])}, str(tmp_path / "out"), "g1", table([("g1",)], "generation string"))
    assert spark.read.parquet(str(tmp_path / "out/g1/docs")).columns == ["sha256"]
    assert spark.read.json(str(tmp_path / "out/pointer")).first()["generation"] == "g1"


@pytest.mark.parametrize("body, reason", [("<!DOCTYPE x><rss><channel/></rss>", "unsafe_markup"), ("<rss><channel><title>t</title></channel></rss>", "empty_feed")])
def test_feeds_fail_closed(table, body, reason):
    got = web.feed_entries(table([(1, body)], "id int, body string"), "id", "body").collect()
    assert [r["rejected"] for r in got] == [reason]


def test_run_vocabularies(table):
    run = {"run_id": "r1", "trigger": "local", "status": "pending_budget", "phases": {}}
    runs, _ = state.read_runs(table([(json.dumps(run),), (json.dumps(run | {"trigger": "manual", "status": "cancelled"}),)], "p string"), "p")
    assert {(r["trigger"], r["status"]) for r in runs.collect()} == {("local", "pending_budget"), ("unknown", "failed")}


def test_links_of_odd_markup(table):
    html = """<!-- <a href="/gone.pdf">x</a> --><a title='a > b href="/no"' href=/p.pdf>Uno<a class="k" href="/q">dos &ntilde;&#x1F600;&bogus;
      <script>var s = "<a href='/s'>s</a>";</script></a><a name="n">none</a><A HREF = '/r?a=1&amp;b=2' download>tres</A ><area href="/z"><a href="">vacío</a><a href="/end">open"""
    got = [(r["link"], r["label"]) for r in web.page_links(table([(1, "https://h.es/", html)], "id int, url string, html string"), "id", "url", "html").orderBy("position").collect()]
    assert got == [("/p.pdf", "Uno"), ("/q", "dos ñ😀&bogus;"), ("/r?a=1&b=2", "tres"), ("", "vacío"), ("/end", "open")]


def test_many_unclosed_anchors_are_read_in_one_pass(table):
    html = "".join(f"<a href=/p{i}>x" for i in range(3000)) + "<a href=" + "y" * 50000
    assert web.page_links(table([(1, "https://h.es/", html)], "id int, url string, html string"), "id", "url", "html").count() == 3000


def test_stored_originals_are_listed_by_tasks(spark, tmp_path):
    good = {hashlib.sha256(c).hexdigest(): c for c in (b"", b"one", b"two" * 500_000)}
    for i, (name, content) in enumerate(good.items()):
        folder = tmp_path / (["", "ab", "cd/ef"][i])
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.pdf").write_bytes(content)
    for left_out in ("_temporary/x.pdf", ".hidden/x.pdf", "ab/_x.pdf", "ab/x.txt"):
        (tmp_path / left_out).parent.mkdir(exist_ok=True)
        (tmp_path / left_out).write_bytes(b"x")
    found = state.stored_originals(spark, str(tmp_path))
    # Nothing of the list of files is part of the plan that the driver holds.
    assert not found.inputFiles()
    assert sorted((r["sha256"], r["actual_sha256"], r["bytes"], r["verified"]) for r in found.collect()) == sorted((n, n, len(c), True) for n, c in good.items())
