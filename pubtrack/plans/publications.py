"""Queries over publications and their rows: differences, totals, selection, set algebra.

A publication is one shipping year of ``lineitem``; a vacancy row is one of its lines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pubtrack.operators import diff
from pubtrack.plans.registry import query
from pubtrack.session import load

KEYS = ["l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber"]


def vacancy_rows(spark, d):
    return load(spark, d, "lineitem").withColumn("publication", F.year("l_shipdate"))


@query("snapshot_diff", """
WITH g AS (SELECT year(l_shipdate) AS y, l_suppkey, l_returnflag, l_linestatus, l_linenumber,
  CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS q, count(*) AS n, min(l_orderkey) AS o
  FROM lineitem GROUP BY ALL),
p AS (SELECT y, lag(y) OVER (ORDER BY y) AS prev FROM (SELECT DISTINCT y FROM g)),
a AS (SELECT * FROM g WHERE y IN (SELECT y FROM p WHERE prev IS NOT NULL)),
b AS (SELECT p.y AS y, g.* EXCLUDE (y) FROM g JOIN p ON p.prev = g.y),
f AS (SELECT coalesce(a.y, b.y) AS publication, coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey,
  coalesce(a.l_returnflag, b.l_returnflag) AS l_returnflag, coalesce(a.l_linestatus, b.l_linestatus) AS l_linestatus,
  coalesce(a.l_linenumber, b.l_linenumber) AS l_linenumber, coalesce(b.q, 0) AS before, coalesce(a.q, 0) AS after,
  coalesce(b.n, 0) AS before_rows, coalesce(a.n, 0) AS after_rows, coalesce(a.o, b.o) AS first_orderkey
  FROM a FULL JOIN b ON a.y = b.y AND a.l_suppkey = b.l_suppkey AND a.l_returnflag = b.l_returnflag
   AND a.l_linestatus = b.l_linestatus AND a.l_linenumber = b.l_linenumber)
SELECT CAST(publication AS INTEGER) AS publication, l_suppkey, l_returnflag, l_linestatus, l_linenumber,
 left(sha256(concat_ws(chr(31), l_suppkey, l_returnflag, l_linestatus, l_linenumber)), 24) AS change_id,
 CASE WHEN before = 0 THEN 'appeared' WHEN after = 0 THEN 'disappeared' ELSE 'quantity_changed' END AS kind,
 CAST(before AS BIGINT) AS before, CAST(after AS BIGINT) AS after, CAST(after - before AS BIGINT) AS delta,
 before_rows, after_rows, first_orderkey FROM f WHERE before <> after
""")
def _(spark, d):
    changes = diff.snapshot_diff_series(vacancy_rows(spark, d), "publication", KEYS, "l_quantity", "l_orderkey")
    return changes.withColumnRenamed("first_position", "first_orderkey")


@query("snapshot_diff_pair", """
WITH g AS (SELECT o_orderstatus AS side, o_custkey, o_orderpriority, count(*) AS n,
  CAST(sum(CAST(trunc(o_totalprice) AS BIGINT)) AS BIGINT) AS q FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL),
f AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority,
  coalesce(b.q, 0) AS before, coalesce(a.q, 0) AS after, coalesce(b.n, 0) AS before_rows, coalesce(a.n, 0) AS after_rows
  FROM (SELECT * FROM g WHERE side = 'O') a FULL JOIN (SELECT * FROM g WHERE side = 'F') b
  ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority)
SELECT o_custkey, o_orderpriority,
 CASE WHEN before = 0 THEN 'appeared' WHEN after = 0 THEN 'disappeared' ELSE 'quantity_changed' END AS kind,
 CAST(before AS BIGINT) AS before, CAST(after AS BIGINT) AS after, CAST(after - before AS BIGINT) AS delta,
 before_rows, after_rows FROM f WHERE before <> after
""")
def _(spark, d):
    orders = load(spark, d, "orders")
    changes = diff.snapshot_diff(
        orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'"),
        ["o_custkey", "o_orderpriority"], "o_totalprice", "o_orderkey")
    return changes.drop("first_position", "change_id")


@query("publication_totals", """
SELECT CAST(year(l_shipdate) AS INTEGER) AS publication, count(*) AS row_count,
 CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS places FROM lineitem GROUP BY 1
""")
def _(spark, d):
    return diff.publication_totals(vacancy_rows(spark, d), ["publication"], "l_quantity")


MONTHS = """
WITH p AS (SELECT o_orderpriority AS scope, strftime(o_orderdate, '%Y-%m') AS published,
  CASE WHEN month(o_orderdate) % 4 <> 0 THEN year(o_orderdate) END AS course, count(*) AS n FROM orders GROUP BY ALL)
"""


@query("compatible_publications", MONTHS + """
SELECT b.scope, b.published, CAST(b.course AS INTEGER) AS course,
 (SELECT max(a.published) FROM p a WHERE a.scope = b.scope AND a.published < b.published
   AND (a.course IS NULL OR b.course IS NULL OR a.course = b.course)) AS previous_published FROM p b
""")
def _(spark, d):
    orders = load(spark, d, "orders")
    course = F.when(F.month("o_orderdate") % 4 != 0, F.year("o_orderdate"))
    publications = (orders.groupBy(F.col("o_orderpriority").alias("scope"),
                                   F.date_format("o_orderdate", "yyyy-MM").alias("published"), course.alias("course"))
                    .agg(F.count(F.lit(1)).alias("n"))
                    .withColumn("id", F.concat_ws("|", "scope", "published")))
    return diff.previous_compatible(publications, "id", "scope", "course", "published").select(
        "scope", "published", "course", "previous_published")


@query("current_previous_publication", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders WHERE o_orderstatus IN ('F', 'O')),
c AS (SELECT o_custkey, o_orderkey AS current_id, o_orderpriority AS p FROM r WHERE rn = 1)
SELECT c.o_custkey, c.current_id, (SELECT arg_max(r.o_orderkey, (r.o_orderdate, r.o_orderkey)) FROM r
  WHERE r.o_custkey = c.o_custkey AND r.o_orderpriority <> c.p) AS previous_id FROM c
""")
def _(spark, d):
    return diff.current_and_previous(load(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_orderpriority",
                                     F.col("o_orderstatus").isin("F", "O"),
                                     [F.col("o_orderdate"), F.col("o_orderkey")])


@query("latest_notice", """
SELECT o_orderpriority, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_id, max(o_orderdate)::VARCHAR AS latest_at
FROM orders GROUP BY 1
""")
def _(spark, d):
    return load(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest_id"),
        F.date_format(F.max("o_orderdate"), "yyyy-MM-dd HH:mm:ss").alias("latest_at"))


DIGEST = """WITH t AS (SELECT l_orderkey, sha256(concat_ws(chr(31), l_partkey, l_suppkey, l_linenumber,
 CAST(l_quantity AS BIGINT), l_returnflag, l_linestatus)) AS h FROM lineitem),
s AS (SELECT l_orderkey, count(*) AS n, """ + ", ".join(
    f"CAST(sum(('0x' || substr(h, {1 + 12 * i}, 12))::BIGINT) AS HUGEINT) AS d{i}" for i in range(5)) + """
 FROM t GROUP BY 1)
SELECT l_orderkey, sha256(concat_ws(':', d0, d1, d2, d3, d4, n)) AS semantic_sha256 FROM s"""


@query("semantic_digest", DIGEST)
def _(spark, d):
    lines = load(spark, d, "lineitem").withColumn("qty", F.col("l_quantity").cast("long"))
    return diff.semantic_digest(lines, ["l_orderkey"], ["l_partkey", "l_suppkey", "l_linenumber", "qty",
                                                        "l_returnflag", "l_linestatus"])


@query("duplicate_groups", """
SELECT sha256(text) AS text_sha256, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1
""")
def _(spark, d):
    hashed = load(spark, d, "documents").select(F.sha2("text", 256).alias("text_sha256"))
    return diff.duplicate_groups(hashed, ["text_sha256"])


@query("multiset_equality", """
WITH l AS (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY 1),
r AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT coalesce(l.k, r.k) AS order_id, coalesce(l.n, 0)::BIGINT AS left_count, coalesce(r.n, 0)::BIGINT AS right_count
FROM l FULL JOIN r ON l.k = r.k WHERE coalesce(l.n, 0) <> coalesce(r.n, 0)
""")
def _(spark, d):
    left = load(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"))
    right = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"))
    return diff.multiset_difference(left, right, ["order_id"])


@query("two_path_reconciliation", """
WITH a AS (SELECT c_nationkey AS k FROM customer), b AS (SELECT s_nationkey AS k FROM supplier),
x AS (SELECT k, 'only_left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
 UNION ALL SELECT k, 'only_right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
SELECT k AS code, side, count(*) AS excess FROM x GROUP BY ALL
""")
def _(spark, d):
    left = load(spark, d, "customer").select(F.col("c_nationkey").alias("code"))
    right = load(spark, d, "supplier").select(F.col("s_nationkey").alias("code"))
    gap = diff.multiset_difference(left, right, ["code"])
    excess = F.col("left_count") - F.col("right_count")
    return gap.select("code", F.when(excess > 0, "only_left").otherwise("only_right").alias("side"),
                      F.abs(excess).alias("excess"))


@query("required_difference", """
SELECT o_orderkey AS missing_id FROM orders EXCEPT SELECT l_orderkey FROM lineitem
""")
def _(spark, d):
    required = load(spark, d, "orders").select(F.col("o_orderkey").alias("missing_id"))
    observed = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("missing_id"))
    return required.join(observed, "missing_id", "left_anti").distinct()


@query("protected_intersection", """
SELECT c_nationkey AS code FROM customer INTERSECT SELECT s_nationkey FROM supplier
""")
def _(spark, d):
    return load(spark, d, "customer").select(F.col("c_nationkey").alias("code")).intersect(
        load(spark, d, "supplier").select(F.col("s_nationkey").alias("code")))


@query("restored_subset", """
SELECT o_custkey, bool_and(l_orderkey IS NOT NULL) AS complete, count(*) FILTER (l_orderkey IS NULL) AS missing
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey GROUP BY 1
""")
def _(spark, d):
    restored = load(spark, d, "lineitem").select("l_orderkey").distinct()
    expected = load(spark, d, "orders").select("o_custkey", "o_orderkey")
    joined = expected.join(restored, expected.o_orderkey == restored.l_orderkey, "left")
    return joined.groupBy("o_custkey").agg(F.bool_and(F.col("l_orderkey").isNotNull()).alias("complete"),
                                           F.count_if(F.col("l_orderkey").isNull()).alias("missing"))
