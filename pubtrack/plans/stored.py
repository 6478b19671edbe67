"""Queries over stored forms: state documents, manifests, run logs, list pages, vacancy cells, exports and the
generation store. Each derives the stored form from whole tables and reads it back through the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from pubtrack.operators import extract, generation, ranking, validate
from pubtrack.operators.scan import ordered_scan, rank
from pubtrack.plans.generations import MEMBERS, members
from pubtrack.plans.registry import query
from pubtrack.session import cut, load
from pubtrack.sources import sinks, state
from pubtrack.streaming.runtime import run_folder


def text(column):
    return F.col(column).cast("string")


def stored_state(spark, d):
    """One state document for every order, one per line; some ids, counts and dates break the rules."""
    row = F.struct(F.concat_ws(":", text("l_orderkey"), text("l_linenumber")).alias("id"), F.lit("30000000").alias("center_code"),
                   (F.col("l_quantity").cast("int") - F.when(F.col("l_quantity") > 48, 60).otherwise(0)).alias("quantity"))
    orders = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(row)).alias("rows"), F.count(F.lit(1)).cast("int").alias("n"))
    key = F.col("l_orderkey")
    document = F.struct(
        F.when(key % 10 == 0, text("l_orderkey")).otherwise(F.sha2(text("l_orderkey"), 256)).alias("id"), text("l_orderkey").alias("title"),
        F.when(key % 7 == 0, -1).otherwise(F.col("n")).alias("row_count"), F.col("n").alias("places"),
        F.when(key % 3 == 0, "2024-01-01T00:00:00").otherwise("2024-01-01T00:00:00Z").alias("published_at"), F.col("rows"))
    notice = F.struct(text("l_orderkey").alias("id"), F.lit("https://example.org/").alias("url"))
    check = F.struct(text("l_orderkey").alias("id"), (key % 2 == 0).alias("success"))
    root = run_folder(spark)
    orders.select(F.to_json(F.struct(F.array(document).alias("documents"), F.struct(F.array(notice).alias("notices"), F.array(check).alias("checks")).alias("catalog"))).alias("value")).write.text(root)
    return state.read_state(spark, root, multi_line=False)


@query("state_tables", """
SELECT CASE WHEN l_orderkey % 10 = 0 THEN l_orderkey::VARCHAR ELSE sha256(l_orderkey::VARCHAR) END AS document_id, l_orderkey::VARCHAR AS title, count(*) AS stored_rows,
 CAST(sum(CAST(trunc(l_quantity) AS INTEGER) - CASE WHEN l_quantity > 48 THEN 60 ELSE 0 END) AS BIGINT) AS places, l_orderkey % 2 = 0 AS checked FROM lineitem GROUP BY l_orderkey
""")
def _(spark, d):
    tables = stored_state(spark, d)
    rows = tables["rows"].groupBy("document_id").agg(F.count(F.lit(1)).alias("stored_rows"), F.sum("quantity").alias("places"))
    checks = tables["checks"].select(F.col("id").alias("title"), F.col("success").alias("checked"))
    return tables["publications"].select(F.col("id").alias("document_id"), "title").join(rows, "document_id").join(checks, "title").select(
        "document_id", "title", "stored_rows", "places", "checked")


@query("state_rule_problems", """
WITH o AS (SELECT DISTINCT l_orderkey AS k, CASE WHEN l_orderkey % 10 = 0 THEN l_orderkey::VARCHAR ELSE sha256(l_orderkey::VARCHAR) END AS id FROM lineitem)
SELECT id, 'document_id' AS problem FROM o WHERE k % 10 = 0 UNION ALL SELECT id, 'row_count' FROM o WHERE k % 7 = 0 UNION ALL SELECT id, 'published_at' FROM o WHERE k % 3 = 0
UNION ALL SELECT concat_ws(':', l_orderkey, l_linenumber), 'quantity' FROM lineitem WHERE l_quantity > 48
""")
def _(spark, d):
    return state.state_problems(stored_state(spark, d))


def manifests(spark, d):
    """A nested manifest for every order: its lines are documents, references, observations and amendments."""
    def line(s):
        return F.concat_ws(":", text("l_orderkey"), s["l_linenumber"].cast("string"))

    def document(s):
        amended = F.when(s["l_discount"] > 0.05, F.array(F.struct(F.concat(F.lit("a"), s["l_partkey"].cast("string")).alias("content_id"), F.lit("s").alias("sha256"), F.lit("correction").alias("kind")))).otherwise(
            F.array().cast("array<struct<content_id:string,sha256:string,kind:string>>"))
        return F.struct(line(s).alias("content_id"), s["l_returnflag"].alias("kind"), F.sha2(line(s), 256).alias("sha256"), (s["l_quantity"] > 25).alias("incorporated"),
                        F.when(s["l_returnflag"] == "R", F.lit(True)).alias("observation_only"), amended.alias("amendments"))

    def other(s):
        return F.struct(F.concat(F.lit("r"), line(s)).alias("content_id"), F.lit("s").alias("sha256"), F.lit("x").alias("kind"), (s["l_tax"] > 0.04).alias("incorporated"))

    def seen(s):
        return F.struct(F.concat(F.lit("o"), text("l_orderkey"), F.lit(":"), s["l_linenumber"].cast("string")).alias("content_id"), F.lit("s").alias("sha256"), s["l_returnflag"].alias("kind"))

    # Only the columns of the lines are shuffled, once; the entries with their texts are made of them afterwards.
    lines = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    grouped = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(lines).alias("lines"))
    whole = grouped.select(F.struct(
        F.concat(F.lit("b"), text("l_orderkey")).alias("content_id"), F.lit("s").alias("sha256"), F.transform("lines", document).alias("documents"),
        F.transform(F.filter("lines", lambda s: s["l_linestatus"] == "O"), other).alias("references"),
        F.transform(F.filter("lines", lambda s: s["l_linestatus"] == "F"), seen).alias("observations")).alias("m"))
    root = run_folder(spark)
    whole.select(F.to_json("m").alias("value")).write.option("compression", "gzip").text(root)
    return spark.read.schema(state.MANIFEST).json(root)


ENTRIES = """
WITH e AS (SELECT l_orderkey || ':' || l_linenumber AS content_id, 'document' AS origin, l_quantity > 25 AS incorporated, l_returnflag = 'R' AS observation_only FROM lineitem
 UNION ALL SELECT 'a' || l_partkey, 'amendment', l_quantity > 25, l_returnflag = 'R' FROM lineitem WHERE l_discount > 0.05
 UNION ALL SELECT 'r' || l_orderkey || ':' || l_linenumber, 'reference', l_tax > 0.04, false FROM lineitem WHERE l_linestatus = 'O'
 UNION ALL SELECT 'o' || l_orderkey || ':' || l_linenumber, 'observation', false, true FROM lineitem WHERE l_linestatus = 'F')
"""


@query("manifest_entries", ENTRIES + "SELECT content_id, origin, incorporated, observation_only, count(*) AS entries FROM e GROUP BY ALL")
def _(spark, d):
    flat = state.flatten_manifest(manifests(spark, d))
    return flat.groupBy("content_id", "origin", "incorporated", "observation_only").agg(F.count(F.lit(1)).alias("entries"))


@query("required_documents", ENTRIES + """
, r AS (SELECT content_id FROM e WHERE origin IN ('document', 'amendment') AND NOT observation_only UNION ALL SELECT DISTINCT 'b' || l_orderkey FROM lineitem)
SELECT content_id, count(*) AS copies, count(*) > 1 AS repeated FROM r GROUP BY 1
""")
def _(spark, d):
    required, repeated = state.required_documents(manifests(spark, d))
    listed = required.groupBy("content_id").agg(F.count(F.lit(1)).alias("copies"))
    return listed.join(repeated.select("content_id", F.lit(True).alias("repeated")), "content_id", "left").select(
        "content_id", "copies", F.coalesce("repeated", F.lit(False)).alias("repeated"))


def run_payloads(spark, d):
    """A run record as JSON text for every event; some fields break the rules, some texts are no records."""
    e, n = load(spark, d, "events"), F.col("event_id")
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), (n % by).cast("int"))
    phase = F.struct(pick(["success", "pending_budget", "odd"], 3).alias("status"), (n % 400 - 50).cast("string").alias("exit_code"), F.lit("2024-01-01T00:00:00Z").alias("started_at"))
    record = F.struct(F.concat(F.lit("run-"), n.cast("string"), F.when(n % 11 == 0, " x").otherwise("")).alias("run_id"),
                      pick(["schedule", "workflow_dispatch", "worker_cron", "push", "local", "alien"], 6).alias("trigger"),
                      pick(["running", "success", "failed", "partial", "pending_budget", "skipped", "cancelled"], 7).alias("status"),
                      pick(["2024-01-01T00:00:00Z", "2024-01-01", "soon"], 3).alias("started_at"), F.when(n % 5 == 0, "-1").otherwise((n % 1000).cast("string")).alias("elapsed_seconds"),
                      F.create_map(F.lit("build"), phase).alias("phases"))
    return e.select(F.when(n % 13 == 0, F.lit("not a record")).otherwise(F.to_json(record)).alias("payload"), "event_id")


RUNS = """
WITH n AS (SELECT event_id AS n, CASE WHEN event_id % 11 <> 0 THEN 'run-' || event_id END AS run_id FROM events WHERE event_id % 13 <> 0)
"""


@query("run_log_tables", RUNS + """
SELECT run_id, list_extract(['schedule', 'workflow_dispatch', 'worker_cron', 'push', 'local', 'unknown'], 1 + n % 6) AS "trigger",
 list_extract(['running', 'success', 'failed', 'partial', 'pending_budget', 'skipped', 'failed'], 1 + n % 7) AS status, n % 3 = 0 AS dated,
 CASE WHEN n % 5 <> 0 THEN (n % 1000)::DOUBLE END AS elapsed_seconds FROM n WHERE run_id IS NOT NULL
""")
def _(spark, d):
    runs, _ = state.read_runs(run_payloads(spark, d), "payload")
    return runs.where("run_id IS NOT NULL").select("run_id", "trigger", "status", F.col("started_at").isNotNull().alias("dated"), "elapsed_seconds")


@query("run_log_phases", RUNS + """
SELECT run_id, 'build' AS phase, list_extract(['success', 'pending_budget', 'failed'], 1 + n % 3) AS status, CASE WHEN n % 400 - 50 BETWEEN -255 AND 255 THEN CAST(n % 400 - 50 AS INTEGER) END AS exit_code FROM n WHERE run_id IS NOT NULL
""")
def _(spark, d):
    _, phases = state.read_runs(run_payloads(spark, d), "payload")
    return phases.where("run_id IS NOT NULL").select("run_id", "phase", "status", "exit_code")


def vacancy_cells(spark, d):
    """Seven printed cells for every line item, each breaking a rule now and then."""
    n = F.col("l_partkey")
    cells = F.array(
        F.concat(F.when(n % 11 == 0, "20").otherwise("30"), F.lpad(text("l_suppkey"), 6, "0"), F.lit(" IES RIO")),
        F.when(n % 13 == 0, "  ").otherwise("VILLA DE ARRIBA"),
        F.when(n % 7 == 0, "0490I06 X").when(n % 2 == 0, "0590I06 DIBUJO / INGLES").otherwise("0591123 TALLER"),
        F.when(n % 17 == 0, "??").otherwise(F.lit(validate.QUOTAS[0])), F.lit(validate.ITINERANT[0]),
        F.when(n % 5 == 0, "Completa").when(n % 19 == 0, "Tiempo Parcial 41 horas").otherwise("Tiempo Parcial 12 horas"),
        F.when(n % 23 == 0, "0").otherwise(F.col("l_quantity").cast("int").cast("string")))
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", cells.alias("cells"))


BROKEN = {"empty_cell": "l_partkey % 13 = 0", "center_code": "l_partkey % 11 = 0", "function_code": "l_partkey % 7 = 0", "quota": "l_partkey % 17 = 0",
          "workload": "l_partkey % 5 <> 0 AND l_partkey % 19 = 0", "quantity": "l_partkey % 23 = 0"}


@query("vacancy_rule_violations", "SELECT l_orderkey, l_linenumber, array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN {rule} THEN '{name}' END" for name, rule in BROKEN.items()) + "], lambda x: x IS NOT NULL), ',') AS broken FROM lineitem")
def _(spark, d):
    rows = vacancy_cells(spark, d)
    return validate.with_violations(rows, validate.vacancy_rules(F.col("cells"))).select("l_orderkey", "l_linenumber", F.array_join("violations", ",").alias("broken"))


@query("typed_vacancies", f"""
SELECT concat_ws(':', l_orderkey, 1, l_linenumber) AS id, '30' || lpad(l_suppkey::VARCHAR, 6, '0') AS center_code, CASE WHEN l_partkey % 2 = 0 THEN '0590I06' ELSE '0591123' END AS function_code,
 CASE WHEN l_partkey % 5 = 0 THEN 'full' ELSE 'partial' END AS workload, CASE WHEN l_partkey % 5 <> 0 THEN 12 END AS hours FROM lineitem WHERE NOT ({" OR ".join(f"({r})" for r in BROKEN.values())})
""")
def _(spark, d):
    valid = validate.with_violations(vacancy_cells(spark, d), validate.vacancy_rules(F.col("cells"))).where(F.size("violations") == 0)
    typed = validate.typed_vacancy(valid.withColumn("page", F.lit(1)), "cells", "l_orderkey", "page", "l_linenumber")
    return typed.select("id", "center_code", "function_code", "workload", "hours")


@query("roster_members", """
SELECT n_nationkey AS doc, '0590' || lpad(n_regionkey::VARCHAR, 3, '0') AS specialty, lpad(c_custkey::VARCHAR, 8, '0') AS list_number, upper('LOPEZ, ANA ' || c_mktsegment) AS search_name,
 row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS rank FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def _(spark, d):
    return rosters(spark, d)[0].select("doc", "specialty", "list_number", "search_name", "rank")


@query("roster_violations", """
WITH c AS (SELECT c_nationkey AS doc, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 20 AS p FROM customer)
SELECT DISTINCT doc, CAST(p + 2 AS INTEGER) AS page, 'page_sequence' AS violation FROM c WHERE p % 3 = 2
UNION ALL SELECT DISTINCT doc, CAST(p + 2 AS INTEGER), 'unrecognised_line' FROM c WHERE p % 4 = 3
""")
def _(spark, d):
    return rosters(spark, d)[1].select("doc", "page", "violation")


def rosters(spark, d):
    """List pages of 20 customers for every nation behind a cover; some footers and lines are wrong."""
    nations = load(spark, d, "nation").select(F.col("n_nationkey").alias("doc"), "n_regionkey")
    listed = load(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("doc"))
    listed = ordered_scan(listed.select("doc", "n_regionkey", "c_custkey", "c_mktsegment"), ["doc"], [F.col("c_custkey")], [rank("n")])
    place = F.floor((F.col("n") - 1) / 20).cast("int")
    # Stored, as every kind of line is made from it: otherwise each would scan the customers again.
    placed = cut(listed.withColumn("page", place + 2).withColumn("line_no", ((F.col("n") - 1) % 20 + 10).cast("int")))
    printed = F.concat(F.lpad(text("c_custkey"), 8, "0"), F.lit(" ***1234** LOPEZ, Ana "), F.col("c_mktsegment"), F.lit(" 1.5000"))
    line = lambda frame, number, value: frame.select("doc", "page", F.lit(number).alias("line_no"), value.alias("text"))
    pages = placed.select("doc", "n_regionkey", "page").distinct()
    last = pages.groupBy("doc").agg((F.max("page") + 1).alias("page"))
    lines = placed.select("doc", "page", "line_no", printed.alias("text"))
    lines = lines.unionByName(line(pages, 1, F.lit("Cuerpo: 0590 SECUNDARIA")))
    lines = lines.unionByName(line(pages, 2, F.concat(F.lit("Especialidad: "), F.lpad(text("n_regionkey"), 3, "0"), F.lit(" TALLER"))))
    lines = lines.unionByName(line(pages, 3, F.lit("Lista: 1 ORDINARIA")))
    lines = lines.unionByName(line(pages.where("page % 4 = 1"), 4, F.lit("algo distinto")))
    lines = lines.unionByName(line(pages, 50, F.concat(F.lit("Página "), (F.col("page") + F.when(F.col("page") % 3 == 1, 7).otherwise(-1)).cast("string"))))
    lines = lines.unionByName(line(nations.withColumn("page", F.lit(1)), 1, F.lit("Portada")))
    lines = lines.unionByName(line(last, 1, F.lit("RELACIÓN DEFINITIVA DEL PERSONAL INTERINO EXCLUIDO")))
    return extract.parse_roster(lines, extract.RosterLayout())


@query("exported_tables", """
SELECT 'parts' AS name, p_partkey AS item, p_name AS label, 'g1' AS generation FROM part UNION ALL SELECT 'suppliers', s_suppkey, s_name, 'g1' FROM supplier
""")
def _(spark, d):
    root = run_folder(spark)
    parts = load(spark, d, "part").withColumnsRenamed({"p_partkey": "item", "p_name": "label"})
    suppliers = load(spark, d, "supplier").withColumnsRenamed({"s_suppkey": "item", "s_name": "label"})
    pointer = spark.range(1).select(F.lit("g1").alias("generation"))
    sinks.export({"parts": (parts, ["item", "label"]), "suppliers": (suppliers, ["item", "label"])}, root, "g1", pointer)
    # Only what the pointer names is read.
    current = spark.read.schema("generation string").json(f"{root}/pointer").first()["generation"]
    tables = [spark.read.parquet(f"{root}/{current}/{name}").select(F.lit(name).alias("name"), "item", "label", F.lit(current).alias("generation")) for name in ("parts", "suppliers")]
    return tables[0].unionByName(tables[1])


@query("prefix_archive_append", """
WITH l AS (SELECT DISTINCT doc_id FROM labels)
SELECT sha256(text) AS sha256, coalesce(min(d.doc_id) FILTER (l.doc_id IS NOT NULL), min(d.doc_id)) AS doc_id, 'p' || left(sha256(text), 2) AS prefix FROM documents d LEFT JOIN l USING (doc_id) GROUP BY 1, 3
""")
def _(spark, d):
    path = f"{run_folder(spark)}/archive"
    contents = load(spark, d, "documents").select(F.sha2("text", 256).alias("sha256"), "doc_id")
    # First the documents with a label, then all, then all again, which adds nothing.
    labelled = contents.join(load(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    for batch in (labelled, contents, contents):
        sinks.append_by_prefix(batch.select("sha256", "doc_id"), path, "sha256", "doc_id")
    return spark.read.parquet(path).select("sha256", "doc_id", "prefix")


@query("generation_store_cycle", MEMBERS + """
SELECT id, specialty, list_number, rank() OVER (PARTITION BY specialty ORDER BY list_number) AS rank, 'v1' AS active, 3 AS pointers FROM m
""")
def _(spark, d):
    ranked = ranking.ordinal_rank(members(spark, d), ["specialty"], [F.col("list_number")])
    turned = ranking.ordinal_rank(members(spark, d), ["specialty"], [-F.col("list_number")])  # the same members in another order
    store = generation.GenerationStore(spark, run_folder(spark), "id", ["specialty", "list_number", "rank"])
    for version, rows in (("v1", ranked), ("v2", turned)):
        expected = rows.groupBy("specialty").agg(F.count(F.lit(1)).alias("expected"))
        store.stage(rows, version)
        store.activate(version, store.validate(version, expected, "specialty", "rank"))
    store.stage(turned, "v3")
    store.recover("v3")  # never validated, so its rows go
    store.rollback("v1")
    return store.rows(store.active()).select("id", "specialty", "list_number", "rank", F.lit(store.active()).alias("active"), F.lit(store.pointer_number()).cast("int").alias("pointers"))
