"""Queries over immutable generations: blocks, staging, totals and activation gates. The list members
are the customers; their id is a hash of specialty, block and number."""

from __future__ import annotations

from pyspark.sql import functions as F

from pubtrack.functions.values import short_id
from pubtrack.operators import generation, ranking
from pubtrack.plans.registry import query
from pubtrack.session import load

COLUMNS = ["specialty", "block", "list_number"]
MEMBERS = """
WITH m AS (SELECT left(sha256(concat_ws('|', c_nationkey, c_mktsegment, c_custkey)), 32) AS id, c_nationkey AS specialty, c_mktsegment AS block_name, c_custkey AS list_number FROM customer)
"""


def members(spark, d):
    return load(spark, d, "customer").select(
        short_id(F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_mktsegment", F.col("c_custkey").cast("string")), 32).alias("id"),
        F.col("c_nationkey").alias("specialty"), F.col("c_mktsegment").alias("block_name"), F.col("c_custkey").alias("list_number"))


@query("generation_blocks", MEMBERS + """
, b AS (SELECT id, left(id, 1) AS bucket, (row_number() OVER (PARTITION BY left(id, 1) ORDER BY id) - 1) // 50 AS block, specialty, list_number FROM m)
, z AS (SELECT bucket, block, count(*) AS block_rows, CAST(sum(octet_length(encode('{"id":"' || id || '","specialty":' || specialty || ',"list_number":' || list_number || '}'))) AS BIGINT) AS block_bytes FROM b GROUP BY 1, 2)
SELECT *, block_rows <= 49 AND block_bytes <= 3000 AS within_limits FROM z
""")
def _(spark, d):
    blocks = generation.assign_blocks(members(spark, d), "id", 1, 50)
    return generation.block_sizes(blocks, ["id", "specialty", "list_number"], most_bytes=3000, most_rows=49)


@query("stored_block_rows", MEMBERS + "SELECT left(id, 2) AS bucket, id, specialty, list_number FROM m")
def _(spark, d):
    packed = generation.pack_blocks(generation.assign_blocks(members(spark, d), "id"), "id", ["id", "specialty", "list_number"])
    return generation.unpack_blocks(packed, "id string, specialty int, list_number bigint").select("bucket", "id", "specialty", "list_number")


@query("block_comparison", MEMBERS + """
, s AS (SELECT left(id, 2) AS bucket, string_agg(id || list_number, ',' ORDER BY id) AS c FROM m WHERE specialty <> 3 GROUP BY 1),
o AS (SELECT left(id, 2) AS bucket, string_agg(id || list_number, ',' ORDER BY id) AS c FROM m WHERE specialty <> 4 GROUP BY 1)
SELECT coalesce(s.bucket, o.bucket) AS bucket, CASE WHEN s.c IS NULL THEN 'new' WHEN o.c IS NULL THEN 'not_offered' WHEN s.c = o.c THEN 'unchanged' ELSE 'conflict' END AS outcome
FROM s FULL JOIN o ON s.bucket = o.bucket
""")
def _(spark, d):
    rows = members(spark, d).withColumn("bucket", F.left("id", F.lit(2)))
    stored = generation.block_digests(rows.where("specialty <> 3"), ["bucket"], ["id", "list_number"])
    offered = generation.block_digests(rows.where("specialty <> 4"), ["bucket"], ["id", "list_number"])
    return generation.compare_blocks(stored, offered, ["bucket"])


@query("resumed_load", MEMBERS + """
SELECT id, 'to_load' AS state FROM m WHERE specialty < 20 AND NOT block_name = 'MACHINERY' UNION ALL SELECT id, 'foreign' FROM m WHERE specialty >= 20 AND block_name = 'MACHINERY'
""")
def _(spark, d):
    rows = members(spark, d)
    todo, foreign = generation.resume(rows.where("specialty < 20"), rows.where("block_name = 'MACHINERY'"), "id")
    return todo.select("id", F.lit("to_load").alias("state")).unionByName(foreign.select("id", F.lit("foreign").alias("state")))


@query("micro_batches", """
SELECT (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 40 AS batch, o_orderkey FROM orders
""")
def _(spark, d):
    return generation.micro_batches(load(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")]).select("batch", "o_orderkey")


@query("specialty_totals", """
SELECT code, CAST(sum(n) AS BIGINT) AS members, arg_min(name, at_) AS name FROM (SELECT c_nationkey AS code, 'list' AS name, count(*) AS n, 0 AS at_ FROM customer GROUP BY 1
 UNION ALL SELECT s_nationkey, 'award', count(*), 1 FROM supplier GROUP BY 1) GROUP BY 1
""")
def _(spark, d):
    listed = load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("code")).agg(F.lit("list").alias("name"), F.count(F.lit(1)).alias("members"))
    awards = load(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("code")).agg(F.lit("award").alias("name"), F.count(F.lit(1)).alias("members"))
    return generation.specialty_totals([listed, awards], "code", "name", "members")


@query("generation_identity", MEMBERS + """
, t AS (SELECT sha256(concat_ws(chr(31), id, specialty, list_number)) AS h FROM m)
SELECT sha256(concat_ws(':', """ + ", ".join(f"CAST(sum(('0x' || substr(h, {1 + 12 * i}, 12))::BIGINT) AS HUGEINT)" for i in range(5)) + """, count(*))) AS version_id, count(*) AS row_count FROM t
""")
def _(spark, d):
    return generation.generation_id(members(spark, d), ["id", "specialty", "list_number"])


@query("index_progress", MEMBERS + """
SELECT DISTINCT left(id, 2) AS bucket FROM m WHERE left(id, 2) NOT IN (SELECT left(id, 2) FROM m WHERE specialty < 5)
""")
def _(spark, d):
    rows = members(spark, d).withColumn("bucket", F.left("id", F.lit(2)))
    return generation.missing_blocks(rows, rows.where("specialty < 5"), ["bucket"])


@query("active_generation_rows", """
WITH v AS (SELECT o_orderpriority AS version_id, bool_or(o_orderstatus = 'F') AS ready, max(o_orderdate) AS at_ FROM orders GROUP BY 1), p AS (SELECT arg_max(version_id, (at_, version_id)) AS a FROM v WHERE ready)
SELECT o_orderkey FROM orders, p WHERE o_orderpriority = a
""")
def _(spark, d):
    rows = load(spark, d, "orders").withColumn("version_id", F.col("o_orderpriority"))
    versions = rows.groupBy("version_id").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("ready"), F.max("o_orderdate").alias("at"))
    pointer = versions.where("ready").agg(F.max_by("version_id", F.struct("at", "version_id")).alias("version_id"))
    return generation.active_rows(rows, pointer, versions).select("o_orderkey")


@query("activation_report", """
WITH r AS (SELECT c_nationkey AS s, CASE WHEN c_nationkey = 7 AND c_mktsegment = 'MACHINERY' THEN 1 ELSE row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) END AS rank FROM customer),
c AS (SELECT s, count(*) AS n, count(DISTINCT rank) AS dn, max(rank) AS mx FROM r GROUP BY 1)
SELECT s::VARCHAR AS item, 'count_mismatch' AS problem FROM c WHERE s % 5 = 0 UNION ALL SELECT s::VARCHAR, 'rank_gap_or_repeat' FROM c WHERE dn <> n OR mx <> n
""")
def _(spark, d):
    listed = members(spark, d)
    ranked = ranking.ordinal_rank(listed, ["specialty"], [F.col("block_name"), F.col("list_number")])
    broken = ranked.withColumn("rank", F.when((F.col("specialty") == 7) & (F.col("block_name") == "MACHINERY"), F.lit(1).cast("long")).otherwise(F.col("rank")))
    manifest = listed.groupBy("specialty").agg((F.count(F.lit(1)) + F.when(F.first("specialty") % 5 == 0, 1).otherwise(0)).alias("expected"))
    return generation.activation_report(broken, manifest, "specialty", "rank", "id")


@query("csv_export", """
SELECT l_orderkey, l_linenumber, l_partkey, '"' || l_orderkey || '";"' || CASE WHEN l_returnflag = 'A' THEN '''=A' WHEN l_returnflag = 'R' THEN 'say ""R""' ELSE l_returnflag END
 || '";"' || coalesce(strftime(o_orderdate, '%Y-%m-%d'), '') || '"' AS line FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey
""")
def _(spark, d):
    from pubtrack.sources.sinks import csv_line
    lines, orders = load(spark, d, "lineitem"), load(spark, d, "orders")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey, "left")
    flag = F.when(F.col("l_returnflag") == "A", "=A").when(F.col("l_returnflag") == "R", 'say "R"').otherwise(F.col("l_returnflag"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", csv_line([F.col("l_orderkey"), flag, F.date_format("o_orderdate", "yyyy-MM-dd")]).alias("line"))


@query("registry_dimension", """
SELECT n_nationkey AS source_id, r_name AS family, CASE WHEN n_nationkey % 4 = 0 THEN 50 ELSE n_nationkey END AS priority, CASE WHEN n_nationkey % 3 = 0 THEN 'recent' ELSE 'historical' END AS queue FROM nation LEFT JOIN region ON r_regionkey = n_regionkey
""")
def _(spark, d):
    from pubtrack.sources.state import registry_sources
    raw = load(spark, d, "nation").join(F.broadcast(load(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(
        F.col("n_nationkey").alias("source_id"), F.col("r_name").alias("family"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey")).alias("priority"),
        F.when(F.col("n_nationkey") % 3 != 0, "historical").alias("queue"))
    return registry_sources(raw).select("source_id", "family", "priority", "queue")
