"""Queries over documents, reviewed labels, their evidence and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from pubtrack.functions.values import row_text
from pubtrack.operators import filters, history, inventory
from pubtrack.operators.scan import dealt, ordered_scan, partitions_for, rank
from pubtrack.plans.registry import query
from pubtrack.session import load
from pubtrack.sources import state
from pubtrack.streaming.runtime import run_folder

DOCS = """
WITH docs AS (SELECT doc_id, sha256(text) AS digest, lang, source, n_chars FROM documents),
rev AS (SELECT l.doc_id, CASE WHEN l.toxic = 1 THEN sha256(d.text || '!') ELSE sha256(d.text) END AS digest,
  CASE WHEN l.quality = 0 THEN sha256(d.text) END AS supersedes, l.quality FROM labels l JOIN documents d USING (doc_id))
"""


def docs(spark, d):
    return load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), "lang", "source", "n_chars")


def reviewed(spark, d):
    joined = load(spark, d, "labels").join(load(spark, d, "documents"), "doc_id")
    return joined.select(
        "doc_id", F.when(F.col("toxic") == 1, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)).alias("digest"),
        F.when(F.col("quality") == 0, F.sha2("text", 256)).alias("supersedes"), "quality")


def renamed(spark, d, lang):
    """Another version of the whole table, in which the documents of one language have other ids."""
    return docs(spark, d).withColumn("doc_id", F.when(F.col("lang") == lang, -F.col("doc_id") - 1).otherwise(F.col("doc_id")))


RENAMED = "(SELECT * REPLACE (CASE WHEN lang = '{}' THEN -doc_id - 1 ELSE doc_id END AS doc_id) FROM docs)"


@query("manifest_reconciliation", DOCS + f"""
SELECT coalesce(r.doc_id, p.doc_id) AS doc_id, coalesce(r.digest, p.digest) AS digest,
 CASE WHEN r.doc_id IS NULL THEN 'kept_prior' WHEN p.doc_id IS NULL THEN 'reviewed' WHEN r.digest = p.digest THEN 'unchanged'
  WHEN r.supersedes = p.digest THEN 'superseded' ELSE 'conflict' END AS outcome
FROM rev r FULL JOIN {RENAMED.format("es")} p ON p.doc_id = r.doc_id
""")
def _(spark, d):
    return inventory.reconcile_manifest(reviewed(spark, d), renamed(spark, d, "es"), "doc_id", "digest", "supersedes")


@query("merged_collections", DOCS + """
, u AS (SELECT 0 AS ord, digest, lang, doc_id AS checked FROM docs UNION ALL SELECT 1, CASE WHEN lang = 'en' THEN sha256(digest) ELSE digest END, lang, doc_id FROM docs
 UNION ALL SELECT 2, digest, CASE WHEN n_chars > 5000 THEN 'xx' ELSE lang END, doc_id FROM docs)
SELECT digest, arg_max(lang, (ord, lang)) AS lang, count(*) AS entries, min(lang) <> max(lang) AS conflict FROM u GROUP BY 1
""")
def _(spark, d):
    base = docs(spark, d).select("digest", "lang", F.col("doc_id").alias("checked"), "n_chars")
    # Whole collections: the second holds other texts for one language, the third other languages for long texts.
    second = base.withColumn("digest", F.when(F.col("lang") == "en", F.sha2("digest", 256)).otherwise(F.col("digest")))
    third = base.withColumn("lang", F.when(F.col("n_chars") > 5000, "xx").otherwise(F.col("lang")))
    merged = inventory.merge_collections([base, second, third], "digest", ["lang"], ["checked"])
    return merged.drop("checked")


@query("reviewed_precedence", DOCS + f"""
SELECT coalesce(r.doc_id, a.doc_id) AS doc_id, coalesce(r.digest, a.digest) AS digest, coalesce(CAST(r.quality AS BIGINT), a.n_chars) AS weight,
 coalesce(a.digest = coalesce(r.digest, a.digest), false) AS incorporated FROM rev r FULL JOIN {RENAMED.format("de")} a ON a.doc_id = r.doc_id
""")
def _(spark, d):
    return inventory.reviewed_precedence(
        reviewed(spark, d).withColumn("weight", F.col("quality").cast("long")),
        renamed(spark, d, "de").withColumn("weight", F.col("n_chars")), "doc_id", "digest", ["weight"])


VERIFY = DOCS + """
, s AS (SELECT d.doc_id, CASE WHEN d.lang = 'fr' THEN NULL ELSE d.digest END AS fetched, r.digest AS expected,
 CASE WHEN d.n_chars % 7 = 0 THEN sha256('old' || d.doc_id) END AS prior, CASE WHEN d.n_chars % 5 = 0 THEN 'provisional' ELSE 'list' END AS kind,
 r.quality = 1 AS active, CASE WHEN d.lang = 'fr' AND d.n_chars % 2 = 0 THEN 'traversal_limit' WHEN d.lang = 'fr' THEN 'timeout' END AS error
 FROM docs d LEFT JOIN rev r USING (doc_id))
"""


@query("verification_states", VERIFY + """
SELECT doc_id, CASE WHEN error = 'traversal_limit' THEN 'skipped' WHEN error IS NOT NULL THEN 'unavailable'
 WHEN fetched = expected AND kind = 'provisional' THEN 'pending_review' WHEN fetched = expected AND active THEN 'incorporated'
 WHEN fetched = expected THEN 'pending_review' WHEN expected IS NOT NULL OR fetched <> prior THEN 'changed' ELSE 'pending_review' END AS status FROM s
""")
def _(spark, d):
    met = docs(spark, d).join(reviewed(spark, d).select("doc_id", F.col("digest").alias("expected"), "quality"), "doc_id", "left")
    french = F.col("lang") == "fr"
    status = inventory.verification_status(
        F.when(~french, F.col("digest")), F.col("expected"),
        F.when(F.col("n_chars") % 7 == 0, F.sha2(F.concat(F.lit("old"), F.col("doc_id").cast("string")), 256)),
        F.when(F.col("n_chars") % 5 == 0, "provisional").otherwise("list"), F.col("quality") == 1, F.lit(None).cast("string"),
        F.when(french & (F.col("n_chars") % 2 == 0), "traversal_limit").when(french, "timeout"))
    return met.select("doc_id", status.alias("status"))


@query("intake_decisions", DOCS + """
, req AS (SELECT d.doc_id, CASE WHEN n_chars % 11 = 0 THEN 'x' ELSE d.digest END AS stated, d.digest AS actual, n_chars % 13 <> 0 AS ok FROM docs d),
pins AS (SELECT doc_id, count(*) AS n, min(digest) AS digest FROM (SELECT doc_id, digest FROM rev UNION ALL SELECT doc_id, digest FROM rev WHERE quality = 0) GROUP BY 1)
SELECT req.doc_id, CASE WHEN actual <> stated THEN 'hash_mismatch' WHEN NOT ok THEN 'invalid_document' WHEN n > 1 THEN 'manifest_conflict'
 WHEN n IS NULL THEN 'unreviewed_document' WHEN pins.digest <> actual THEN 'manifest_mismatch' END AS reason FROM req LEFT JOIN pins USING (doc_id)
""")
def _(spark, d):
    pinned = reviewed(spark, d)
    pins = pinned.unionByName(pinned.where("quality = 0")).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("digest").alias("pinned"))
    met = docs(spark, d).join(pins, "doc_id", "left")
    reason = inventory.intake_reason(
        F.col("digest"), F.when(F.col("n_chars") % 11 == 0, "x").otherwise(F.col("digest")), F.col("n_chars") % 13 != 0,
        F.coalesce("n", F.lit(0)), F.col("pinned") == F.col("digest"))
    return met.select("doc_id", reason.alias("reason"))


@query("reviewed_update_audit", DOCS + f"""
SELECT coalesce(d.doc_id, r.doc_id) AS doc_id, d.doc_id IS NULL AS missing_from_index,
 CASE WHEN d.doc_id IS NULL THEN NULL WHEN n_chars % 5 = 0 AND r.doc_id IS NOT NULL THEN 'classification_conflict' WHEN n_chars % 5 = 0 THEN 'not_applicable'
  WHEN n_chars % 17 = 0 THEN 'unavailable' WHEN r.doc_id IS NULL THEN 'pending_review' WHEN r.digest = d.digest THEN 'reviewed' ELSE 'changed' END AS status
FROM {RENAMED.format("es")} d FULL JOIN rev r ON r.doc_id = d.doc_id
""")
def _(spark, d):
    seen = renamed(spark, d, "es").withColumn("_seen", F.lit(True))
    met = seen.join(reviewed(spark, d).select("doc_id", F.col("digest").alias("expected")), "doc_id", "full")
    status = inventory.update_status(F.when(F.col("n_chars") % 5 == 0, "provisional").otherwise("list"), F.col("expected"),
                                     F.col("digest"), F.when(F.col("n_chars") % 17 == 0, "timeout"))
    return met.select("doc_id", F.col("_seen").isNull().alias("missing_from_index"),
                      F.when(F.col("_seen").isNotNull(), status).alias("status"))


@query("evidence_status", DOCS + """
SELECT r.doc_id, CASE WHEN s.digest IS NULL THEN 'original_unavailable' ELSE 'archived' END AS evidence_status,
 s.digest IS NULL AND r.quality = 1 AS violation FROM rev r LEFT JOIN (SELECT DISTINCT digest FROM docs) s USING (digest)
""")
def _(spark, d):
    claimed = reviewed(spark, d).withColumn("claimed", F.col("quality") == 1)
    return inventory.evidence_status(claimed, docs(spark, d), "digest", "claimed").select("doc_id", "evidence_status", "violation")


@query("artifact_verification", DOCS + """
SELECT r.doc_id, r.digest = d.digest AS verified FROM rev r JOIN docs d USING (doc_id)
""")
def _(spark, d):
    stored = docs(spark, d).select("doc_id", F.col("digest").alias("actual"))
    return reviewed(spark, d).join(stored, "doc_id").select("doc_id", F.col("digest").eqNullSafe(F.col("actual")).alias("verified"))


@query("verified_originals", """
SELECT sha256(text) AS sha256, min(doc_id) % 10 <> 3 AS verified, CASE WHEN min(doc_id) % 10 <> 3 THEN octet_length(encode(text)) ELSE octet_length(encode(text)) + 1 END AS bytes FROM documents GROUP BY text
""")
def _(spark, d):
    # Every text is stored as a file named by its hash; some are altered afterwards by one byte.
    path = f"{run_folder(spark)}/originals"
    kept = load(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    content = F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    state.store_originals(kept.select(F.sha2("text", 256).alias("sha256"), content.cast("binary").alias("content")), path, "txt")
    return state.stored_originals(spark, path, "txt").select("sha256", "verified", F.col("bytes"))


@query("accepted_and_quarantined", DOCS + """
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'quarantine' ELSE 'accepted' END AS zone FROM docs d
LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) l USING (doc_id)
""")
def _(spark, d):
    approved = load(spark, d, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    all_docs = docs(spark, d).select("doc_id")
    kept = all_docs.join(approved, "doc_id", "left_semi").withColumn("zone", F.lit("accepted"))
    return kept.unionByName(all_docs.join(approved, "doc_id", "left_anti").withColumn("zone", F.lit("quarantine")))


@query("content_addressed_append", DOCS + """
SELECT digest, min(doc_id) AS first_doc FROM docs WHERE lang <> 'en' AND digest NOT IN (SELECT digest FROM docs WHERE lang = 'en') GROUP BY 1
""")
def _(spark, d):
    from pubtrack.sources.sinks import unseen_content
    all_docs = docs(spark, d)
    return unseen_content(all_docs.where("lang <> 'en'"), all_docs.where("lang = 'en'"), "digest", "doc_id").select(
        "digest", F.col("doc_id").alias("first_doc"))


@query("identity_without_volatile", DOCS + """
SELECT sha256(concat_ws(chr(31), digest, lang)) AS identity, count(*) AS copies, count(DISTINCT source) AS sources FROM docs GROUP BY 1
""")
def _(spark, d):
    stable = docs(spark, d).withColumn("identity", F.sha2(row_text([F.col("digest"), F.col("lang")]), 256))
    per_source = stable.groupBy("identity", "source").agg(F.count(F.lit(1)).alias("n"))
    return per_source.groupBy("identity").agg(F.sum("n").alias("copies"), F.count(F.lit(1)).alias("sources"))


@query("content_revisions", """
WITH o AS (SELECT source, sha256(text) AS digest, doc_id AS seen FROM documents),
f AS (SELECT source, digest, min(seen) AS valid_from, max(seen) AS last_seen, count(*) AS sightings FROM o GROUP BY 1, 2)
SELECT *, lead(valid_from) OVER w AS valid_to, lead(valid_from) OVER w IS NULL AS current FROM f WINDOW w AS (PARTITION BY source ORDER BY valid_from, digest)
""")
def _(spark, d):
    seen = load(spark, d, "documents").select("source", F.sha2("text", 256).alias("digest"), F.col("doc_id").alias("seen"))
    return history.revisions(seen, ["source"], "digest", "seen")


COVER = """
WITH l AS (SELECT r_name AS family, s_nationkey AS source_id, l_orderkey AS doc, min(l_linestatus) AS ls, min(l_returnflag) AS rf, max(l_discount) AS disc
 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2, 3)
"""


def registry(spark, d):
    return load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("r_name").alias("family"))


def scoped(spark, d):
    suppliers = load(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linestatus", "l_returnflag", "l_discount")
    # The registry side is joined first: one small dimension meets the large table once.
    placed = suppliers.join(registry(spark, d), F.col("s_nationkey") == F.col("n_nationkey"))
    # A task's memory follows the rows of its partition, so the table's size sets their number.
    joined = dealt(lines.join(placed, lines.l_suppkey == placed.s_suppkey), partitions_for(lines), "l_orderkey")
    return joined.groupBy("family", F.col("s_nationkey").alias("source_id"), F.col("l_orderkey").alias("doc")).agg(
        F.min(F.ascii("l_linestatus")).alias("ls"), F.min(F.ascii("l_returnflag")).alias("rf"), F.max("l_discount").alias("disc"))


def status():
    return F.when(F.col("rf") == ord("R"), "unavailable").when(F.col("rf") == ord("A"), "skipped").otherwise("ok")


@query("source_coverage", COVER + """
SELECT source_id, count(*) AS document_count, count(*) FILTER (rf = 'R') AS failed_documents, count(*) FILTER (rf = 'A') AS skipped_documents,
 count(*) FILTER (ls <> 'O') AS pending_documents, count(*) FILTER (disc >= 0.09) AS unreviewed_documents,
 count(*) FILTER (ls <> 'O') = 0 AS downloads_complete, count(*) FILTER (ls <> 'O' OR disc >= 0.09) = 0 AS verification_complete FROM l GROUP BY 1
""")
def _(spark, d):
    return inventory.source_coverage(scoped(spark, d), ["source_id"], status(), F.when(F.col("ls") == ord("O"), "checked").otherwise("queued"),
                                     F.col("disc") < 0.09)


@query("family_coverage", COVER + """
, p AS (SELECT family, doc, bool_or(rf = 'R') AS f, bool_or(rf = 'A') AS s, bool_or(ls <> 'O') AS p, bool_or(disc >= 0.09) AS u FROM l GROUP BY 1, 2)
SELECT family, count(*) AS document_count, count(*) FILTER (f) AS failed_documents, count(*) FILTER (s) AS skipped_documents,
 count(*) FILTER (p) AS pending_documents, count(*) FILTER (u) AS unreviewed_documents,
 (SELECT count(*) FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = p.family) AS source_count, count(*) FILTER (p OR u) = 0 AS verification_complete FROM p GROUP BY 1
""")
def _(spark, d):
    return inventory.family_coverage(scoped(spark, d), registry(spark, d), ["family"], "source_id", "doc", status(),
                                     F.when(F.col("ls") == ord("O"), "checked").otherwise("queued"), F.col("disc") < 0.09)


@query("review_completeness", """
SELECT (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS open_documents, (SELECT count(*) FROM lineitem WHERE l_linestatus <> 'O') AS open_announcements,
 (SELECT count(*) FROM supplier WHERE s_acctbal < 0) AS open_sources, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') + (SELECT count(*) FROM lineitem WHERE l_linestatus <> 'O')
 + (SELECT count(*) FROM supplier WHERE s_acctbal < 0) = 0 AS review_complete, 'stated' AS state
UNION ALL SELECT (SELECT count(*) FROM orders WHERE o_totalprice < 0), (SELECT count(*) FROM lineitem WHERE l_quantity < 0), (SELECT count(*) FROM supplier WHERE s_suppkey < 0),
 (SELECT count(*) FROM orders WHERE o_totalprice < 0) + (SELECT count(*) FROM lineitem WHERE l_quantity < 0) + (SELECT count(*) FROM supplier WHERE s_suppkey < 0) = 0, 'settled'
""")
def _(spark, d):
    tables = load(spark, d, "orders"), load(spark, d, "lineitem"), load(spark, d, "supplier")
    stated = inventory.review_complete(*tables, F.col("o_orderstatus") == "F", F.col("l_linestatus") == "O", F.col("s_acctbal") >= 0)
    settled = inventory.review_complete(*tables, F.col("o_totalprice") >= 0, F.col("l_quantity") >= 0, F.col("s_suppkey") >= 0)
    return stated.withColumn("state", F.lit("stated")).unionByName(settled.withColumn("state", F.lit("settled")))


@query("document_lineage", """
SELECT DISTINCT l_partkey AS document_id, c_nationkey AS source_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
""")
def _(spark, d):
    return inventory.lineage([(load(spark, d, "lineitem"), "l_partkey", "l_orderkey"), (load(spark, d, "orders"), "o_orderkey", "o_custkey"),
                              (load(spark, d, "customer"), "c_custkey", "c_nationkey")], "document_id", "source_id")


@query("provenance_resolution", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'amendment' WHEN o_orderkey IS NOT NULL THEN 'document' ELSE 'version' END AS evidence_kind,
 CASE WHEN l_returnflag = 'R' THEN 'a' || l_suppkey WHEN o_orderkey IS NOT NULL THEN 'd' || o_orderkey ELSE 'v' || year(l_shipdate) END AS evidence_id
FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey
""")
def _(spark, d):
    lines = load(spark, d, "lineitem")
    known = load(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey")
    joined = lines.join(known, lines.l_orderkey == known.o_orderkey, "left")
    resolved = inventory.resolve_provenance(
        joined, F.when(F.col("l_returnflag") == "R", F.concat(F.lit("a"), F.col("l_suppkey").cast("string"))),
        F.concat(F.lit("d"), F.col("o_orderkey").cast("string")), F.concat(F.lit("v"), F.year("l_shipdate").cast("string")))
    return resolved.select("l_orderkey", "l_linenumber", "l_partkey", "evidence_kind", "evidence_id")


@query("weakest_link_check", """
SELECT o_custkey AS scope, CASE WHEN count(*) = count(c) THEN min(c) END AS checked_at FROM (SELECT o_custkey, o_orderkey,
 CASE WHEN o_orderkey % 29 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS c FROM orders) GROUP BY 1
""")
def _(spark, d):
    checks = load(spark, d, "orders").select(F.col("o_custkey").alias("scope"), F.when(
        F.col("o_orderkey") % 29 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("stamp"))
    return history.weakest_link(checks, ["scope"], "stamp")


@query("archive_entries", """
WITH e AS (SELECT 'document-' || o_orderkey AS id, 'vacancies' AS type, strftime(o_orderdate, '%Y-%m-%d') AS date, 'Datos' AS status FROM orders
 UNION ALL SELECT 'personal-' || c_custkey, 'list', NULL, 'Datos' FROM customer UNION ALL SELECT 'notice-' || s_suppkey, 'notice', NULL, 'Aviso' FROM supplier)
SELECT *, row_number() OVER (ORDER BY coalesce(date, '') DESC, id) AS position FROM e
""")
def _(spark, d):
    published = load(spark, d, "orders").select(F.concat(F.lit("document-"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("vacancies").alias("type"),
                                                F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit("Datos").alias("status"))
    lists = load(spark, d, "customer").select(F.concat(F.lit("personal-"), F.col("c_custkey").cast("string")).alias("id"), F.lit("list").alias("type"),
                                              F.lit("Datos").alias("status"))
    notices = load(spark, d, "supplier").select(F.concat(F.lit("notice-"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("notice").alias("type"),
                                                F.lit("Aviso").alias("status"))
    entries = published.unionByName(lists, allowMissingColumns=True).unionByName(notices, allowMissingColumns=True)
    newest_first = -F.coalesce(F.unix_date(F.to_date("date")), F.lit(0)).cast("long")
    return ordered_scan(entries, [], [newest_first, F.col("id")], [rank("position")])


@query("archive_filter", """
SELECT doc_id FROM documents WHERE contains(lower(strip_accents(source || ' ' || lang)), 'src1')
 AND lang = 'en' AND n_chars % 4 <> 0
""")
def _(spark, d):
    entries = load(spark, d, "documents").select(
        "doc_id", F.col("source").alias("title"), F.col("lang").alias("author"), F.lit("list").alias("type"), F.lit("").alias("course"), F.lit(None).cast("date").alias("date"),
        F.when(F.col("n_chars") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("lang", F.lit("x"))).alias("bodies"))
    return filters.archive_filter(entries, filters.query_words("SRC1"), "list", "en", "unknown", None, None).select("doc_id")


@query("distinct_bodies", """
SELECT DISTINCT unnest(string_split(lower(lang || ',' || source), ',')) AS body FROM documents
""")
def _(spark, d):
    return load(spark, d, "documents").select(F.explode(F.split(F.lower(F.concat_ws(",", "lang", "source")), ",")).alias("body")).distinct()
