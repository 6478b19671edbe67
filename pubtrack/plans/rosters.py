"""Queries over ranked lists. Specialty = nation, block = market segment, list number = customer key;
orders play awards, that is records without a rank."""

from __future__ import annotations

from pyspark.sql import functions as F

from pubtrack.functions.text import fold_upper
from pubtrack.functions.values import membership_key, short_id
from pubtrack.operators import ranking, validate
from pubtrack.plans.registry import query
from pubtrack.session import cut, load, small_side



def members(spark, d):
    return load(spark, d, "customer").select(
        F.col("c_nationkey").alias("specialty"), F.col("c_mktsegment").alias("block"),
        F.col("c_custkey").alias("list_number"), F.col("c_name").alias("name"))


def ranked(spark, d):
    return ranking.ordinal_rank(members(spark, d), ["specialty"], [F.col("block"), F.col("list_number")])


@query("ordinal_rank", """
SELECT c_nationkey AS specialty, c_mktsegment AS block, c_custkey AS list_number, c_name AS name,
 row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) AS rank FROM customer
""")
def _(spark, d):
    return ranked(spark, d)


@query("global_rank", """
SELECT c_custkey AS list_number, row_number() OVER (ORDER BY CASE WHEN c_mktsegment = 'MACHINERY' THEN 0 ELSE 1 END,
 c_custkey) AS rank FROM customer
""")
def _(spark, d):
    block_order = F.when(F.col("block") == "MACHINERY", 0).otherwise(1)
    return ranking.ordinal_rank(members(spark, d), [], [block_order, F.col("list_number")]).select("list_number", "rank")


@query("number_order_violations", """
WITH s AS (SELECT l_orderkey, l_shipdate, l_partkey, l_linenumber, lag(l_linenumber) OVER (PARTITION BY l_orderkey
  ORDER BY l_shipdate, l_partkey, l_linenumber, l_suppkey, l_extendedprice) AS previous_number FROM lineitem)
SELECT l_orderkey, l_linenumber, previous_number FROM s WHERE previous_number >= l_linenumber
""")
def _(spark, d):
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_partkey", "l_linenumber", "l_suppkey",
                                              "l_extendedprice")
    reading = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice")]
    return ranking.order_violations(lines, ["l_orderkey"], reading, "l_linenumber").select(
        "l_orderkey", "l_linenumber", "previous_number")


@query("neighbour_adjacency", """
SELECT c_nationkey AS specialty, c_mktsegment AS block, c_custkey AS list_number,
 lag(c_custkey) OVER w AS number_before, lead(c_custkey) OVER w AS number_after
FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey)
""")
def _(spark, d):
    return ranking.neighbours(members(spark, d), ["specialty", "block"], [F.col("list_number")], "list_number").drop("name")


INSERTIONS = """
WITH ins AS (SELECT c_nationkey AS specialty, CASE WHEN s_suppkey % 10 = 9 THEN 'UNKNOWN' ELSE c_mktsegment END AS block,
  CASE WHEN s_suppkey % 7 = 0 THEN c_custkey ELSE 1000000 + s_suppkey END AS list_number, s_name AS name
  FROM supplier JOIN customer ON c_custkey = s_suppkey),
j AS (SELECT i.*, (SELECT max(c_custkey) FROM customer WHERE c_nationkey = i.specialty AND c_mktsegment = i.block AND c_custkey < i.list_number) AS b,
 (SELECT min(c_custkey) FROM customer WHERE c_nationkey = i.specialty AND c_mktsegment = i.block AND c_custkey > i.list_number) AS a,
 (SELECT bool_or(c_custkey = i.list_number) FROM customer WHERE c_nationkey = i.specialty AND c_mktsegment = i.block) AS p FROM ins i),
v AS (SELECT specialty, block, list_number, name, b AS number_before, a AS number_after, CASE WHEN p IS NULL THEN 'unknown_block'
 WHEN p THEN 'already_present' WHEN a IS NOT NULL AND b IS NOT NULL THEN 'bracketed' ELSE 'edge' END AS verdict FROM j)
"""


def insertions(spark, d):
    supplier = load(spark, d, "supplier")
    joined = supplier.join(members(spark, d), supplier.s_suppkey == F.col("list_number"))
    return joined.select(
        "specialty", F.when(F.col("s_suppkey") % 10 == 9, "UNKNOWN").otherwise(F.col("block")).alias("block"),
        F.when(F.col("s_suppkey") % 7 == 0, F.col("list_number")).otherwise(1000000 + F.col("s_suppkey")).alias("list_number"),
        F.col("s_name").alias("name"))


@query("insertion_verdicts", INSERTIONS + "SELECT specialty, block, list_number, number_before, number_after, verdict FROM v")
def _(spark, d):
    return ranking.check_insertions(members(spark, d), insertions(spark, d), ["specialty", "block"], "list_number")


@query("amended_list", INSERTIONS + """
, m AS (SELECT c_nationkey AS specialty, c_mktsegment AS block, c_custkey AS list_number, c_name AS name, false AS inserted FROM customer
 UNION ALL SELECT specialty, block, list_number, name, true FROM v WHERE verdict IN ('bracketed', 'edge'))
SELECT *, left(sha256(concat_ws('|', specialty, block, list_number, name)), 32) AS member_id,
 row_number() OVER (PARTITION BY specialty ORDER BY block, list_number, name) AS rank FROM m
""")
def _(spark, d):
    return ranking.apply_insertions(members(spark, d), insertions(spark, d), "specialty", "block", F.col("block"),
                                    "list_number", "name", "name")


CORRECTIONS = """
WITH base AS (SELECT c_custkey AS list_number, c_name AS name, c_mktsegment AS code FROM customer),
chg AS (SELECT o_orderkey AS change_id, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 1 ELSE o_custkey END AS list_number,
  c_name AS name, o_orderpriority AS code FROM orders JOIN customer ON c_custkey = o_custkey),
judged AS (SELECT g.change_id, g.list_number, g.name, g.code, count(b.list_number) AS name_matches,
  CASE WHEN count(b.list_number) <> 1 OR bool_or(b.list_number = g.list_number) IS NOT TRUE THEN 'ambiguous_member'
   WHEN bool_or(b.code = g.code) THEN 'already_present' ELSE 'applied' END AS outcome
  FROM chg g LEFT JOIN base b ON b.name = g.name GROUP BY ALL)
"""


def corrections(spark, d):
    base = members(spark, d).select("list_number", "name", F.array("block").alias("codes"))
    orders = load(spark, d, "orders")
    named = orders.join(base.select(F.col("list_number").alias("o_custkey"), "name"), "o_custkey")
    changes = named.select(
        F.col("o_orderkey").alias("change_id"),
        F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("list_number"),
        "name", F.col("o_orderpriority").alias("code"))
    return ranking.apply_corrections(base, changes, "list_number", "name", "codes")


@query("correction_outcomes", CORRECTIONS + "SELECT change_id, outcome, name_matches FROM judged")
def _(spark, d):
    return corrections(spark, d)[1].select("change_id", "outcome", "name_matches")


@query("corrected_members", CORRECTIONS + """
, app AS (SELECT list_number, min(change_id) AS first_change, list(DISTINCT code) AS added FROM judged WHERE outcome = 'applied' GROUP BY 1)
SELECT b.list_number, b.name, first_change, first_change IS NOT NULL AS amended,
 array_to_string(list_sort(list_distinct(list_concat([b.code], coalesce(added, [])))), ',') AS codes
FROM base b LEFT JOIN app ON app.list_number = b.list_number
""")
def _(spark, d):
    return corrections(spark, d)[0].withColumn("codes", F.array_join("codes", ","))


@query("rank_completeness", """
WITH n AS (SELECT c_nationkey AS specialty, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) AS rank FROM customer),
r AS (SELECT specialty, CASE WHEN specialty % 5 = 1 AND rank = 2 THEN 1 WHEN specialty % 5 = 2 THEN rank + 1 WHEN specialty % 5 = 3 AND rank > 4 THEN rank + 3 ELSE rank END AS rank, count(*) AS n FROM n GROUP BY ALL)
SELECT specialty, CAST(sum(n) AS BIGINT) AS ranked, min(rank) AS first_rank, max(rank) AS last_rank, count(*) FILTER (n > 1) AS repeated_ranks,
 min(rank) = 1 AND max(rank) = sum(n) AND count(*) FILTER (n > 1) = 0 AS complete FROM r GROUP BY 1
""")
def _(spark, d):
    # Some rosters repeat a rank, start late or have a gap.
    kind, rank = F.col("specialty") % 5, F.col("rank")
    printed = F.when((kind == 1) & (rank == 2), 1).when(kind == 2, rank + 1).when((kind == 3) & (rank > 4), rank + 3).otherwise(rank)
    return validate.rank_completeness(ranked(spark, d).withColumn("rank", printed.cast("long")), ["specialty"], "rank")


@query("roster_completeness", """
WITH r AS (SELECT l_suppkey AS roster_id, l_linenumber AS rank, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT roster_id, CAST(sum(n) AS BIGINT) AS ranked, min(rank) AS first_rank, max(rank) AS last_rank,
 count(*) FILTER (n > 1) AS repeated_ranks,
 min(rank) = 1 AND max(rank) = sum(n) AND count(*) FILTER (n > 1) = 0 AS complete FROM r GROUP BY 1
""")
def _(spark, d):
    lines = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("roster_id"), F.col("l_linenumber").alias("rank"))
    return validate.rank_completeness(lines, ["roster_id"], "rank")


@query("duplicate_ranks", """
SELECT l_orderkey AS specialty, l_linenumber AS rank, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
""")
def _(spark, d):
    lines = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("specialty"), F.col("l_linenumber").alias("rank"))
    return validate.duplicate_ranks(lines, ["specialty"], "rank")


@query("evidence_counts", """
SELECT o_orderpriority AS source_id, c_nationkey AS specialty, count(*) AS record_count
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2
""")
def _(spark, d):
    awards = load(spark, d, "orders").join(members(spark, d), F.col("o_custkey") == F.col("list_number"))
    records = awards.select(F.col("o_orderpriority").alias("source_id"), "specialty", F.lit(None).cast("long").alias("rank"))
    return validate.evidence_counts(records, "rank", ["source_id", "specialty"])


@query("manifest_totals", """
WITH c AS (SELECT c_nationkey AS code, count(*) AS observed FROM customer GROUP BY 1),
m AS (SELECT n_nationkey AS code, CASE WHEN n_regionkey = 0 THEN 60 ELSE (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) END AS expected FROM nation)
SELECT coalesce(c.code, m.code) AS code, observed, expected, observed IS NOT DISTINCT FROM expected AS matches
FROM c FULL JOIN m ON c.code = m.code
""")
def _(spark, d):
    counts = load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("code")).agg(F.count(F.lit(1)).alias("observed"))
    nation = load(spark, d, "nation").select(F.col("n_nationkey").alias("code"), "n_regionkey")
    manifest = nation.join(counts, "code", "left").select(
        "code", F.when(F.col("n_regionkey") == 0, F.lit(60).cast("long")).otherwise(F.coalesce("observed", F.lit(0))).alias("expected"))
    return validate.manifest_gate(counts, manifest, ["code"], "observed", "expected")


@query("record_validation", """
WITH r AS (SELECT c_custkey, c_nationkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) AS rank FROM customer),
m AS (SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 1 THEN 40 ELSE 1000000 END AS allowed FROM nation WHERE n_regionkey <> 2)
SELECT c_custkey AS list_number, CASE WHEN n_name IS NULL THEN 'unknown_specialty' WHEN rank > allowed THEN 'rank_beyond_count' END AS violation
FROM r LEFT JOIN m ON n_nationkey = c_nationkey WHERE n_name IS NULL OR rank > allowed
""")
def _(spark, d):
    nation = load(spark, d, "nation").where("n_regionkey <> 2").select(
        F.col("n_nationkey").alias("specialty"), "n_name",
        F.when(F.col("n_regionkey") == 1, 40).otherwise(1000000).alias("allowed"))
    joined = ranked(spark, d).join(small_side(nation), "specialty", "left")
    rules = {"unknown_specialty": F.col("n_name").isNotNull(),
             "rank_beyond_count": F.col("n_name").isNull() | (F.col("rank") <= F.col("allowed"))}
    bad = validate.split(validate.with_violations(joined, rules))[1]
    return bad.select("list_number", F.array_join("violations", ",").alias("violation"))


@query("row_rule_violations", """
WITH r AS (SELECT year(l_shipdate) AS publication, unnest([
  CASE WHEN NOT (l_quantity BETWEEN 1 AND 45) THEN 'quantity' END,
  CASE WHEN NOT regexp_full_match(l_returnflag, '[AN]') THEN 'flag' END,
  CASE WHEN NOT (l_linenumber BETWEEN 1 AND 6) THEN 'line' END,
  CASE WHEN l_discount > l_tax + 0.08 THEN 'discount' END]) AS rule FROM lineitem)
SELECT CAST(publication AS INTEGER) AS publication, rule, count(*) AS row_count FROM r WHERE rule IS NOT NULL GROUP BY 1, 2
""")
def _(spark, d):
    lines = load(spark, d, "lineitem").withColumn("publication", F.year("l_shipdate"))
    rules = {"quantity": F.col("l_quantity").between(1, 45), "flag": F.rlike("l_returnflag", F.lit("^[AN]$")),
             "line": F.col("l_linenumber").between(1, 6), "discount": ~(F.col("l_discount") > F.col("l_tax") + 0.08)}
    return validate.violation_counts(validate.with_violations(lines, rules), ["publication"])


# Members of a nation are a roster of three pages, each region has one amendment; some records break a rule.
@query("record_violations", """
WITH m AS (SELECT c_custkey AS k, c_nationkey AS n, c_custkey % 12 AS c, c_custkey % 2 = 0 AS amended FROM customer),
r AS (SELECT k, unnest([CASE WHEN c = 1 THEN 'identity' END, CASE WHEN c = 2 THEN 'source' END, CASE WHEN c = 3 THEN 'list_number' END, CASE WHEN c = 4 THEN 'text' END, CASE WHEN c = 5 THEN 'block' END,
 CASE WHEN c = 6 THEN 'rank' END, CASE WHEN c = 7 OR c = 2 AND k % 5 = 4 THEN 'page' END, CASE WHEN c = 8 THEN 'baseline_page' END, CASE WHEN c = 9 THEN 'codes' END, CASE WHEN c = 10 THEN 'codes_state' END,
 CASE WHEN k % 5 = 1 AND (NOT amended OR c = 2) OR k % 5 = 2 AND (NOT amended OR c IN (2, 3, 8, 9, 10)) OR k % 5 = 3 THEN 'relation' END]) AS rule FROM m)
SELECT k, rule FROM r WHERE rule IS NOT NULL
""")
def _(spark, d):
    k = F.col("c_custkey")
    case, kind, amended = k % 12, k % 5, k % 2 == 0
    identity = F.when(case == 1, "no id").otherwise(F.left(F.sha2(k.cast("string"), 256), F.lit(32)))
    number = F.when(case == 3, "12").otherwise(F.lpad(k.cast("string"), 8, "0"))
    roster, own = F.concat(F.lit("n"), F.col("c_nationkey")), F.when(amended, F.concat(F.lit("a"), F.col("c_nationkey"))).otherwise(F.concat(F.lit("n"), F.col("c_nationkey")))
    code = lambda value, name: F.struct(F.lit(value).alias("code"), F.lit(name).alias("name"))
    codes = F.when(case == 9, F.array(code("0597031", "x"), code("031", "y"))).otherwise(F.array(code("032", "x"), code("597033", "y")))
    baseline = F.when(case == 8, 9).otherwise(2)
    nobody = F.lit(None).cast("string")
    relation = F.when(kind == 1, F.struct(F.lit("inclusion").alias("kind"), nobody.alias("previous_id"), nobody.alias("previous_number"), nobody.alias("source"), F.lit(None).cast("int").alias("page"), nobody.alias("code"), nobody.alias("printed")))
    relation = relation.when(kind == 2, F.struct(F.lit("habilitation_added").alias("kind"), F.when(case == 1, "no id").otherwise(identity).alias("previous_id"), F.when(case == 3, "99").otherwise(number).alias("previous_number"),
                                                 roster.alias("source"), baseline.alias("page"), F.lit("032").alias("code"), F.when(case == 10, "032").otherwise("0597032").alias("printed")))
    relation = relation.when(kind == 3, F.struct(F.lit("moved").alias("kind"), nobody.alias("previous_id"), nobody.alias("previous_number"), nobody.alias("source"), F.lit(None).cast("int").alias("page"), nobody.alias("code"), nobody.alias("printed")))
    records = load(spark, d, "customer").select(
        k.alias("k"), identity.alias("id"), nobody.alias("membership_id"), number.alias("list_number"), F.when(case == 4, "").otherwise(F.col("c_name")).alias("name"), F.when(case == 6, 0).otherwise(1).alias("rank"),
        F.when(case == 5, "III").otherwise("I").alias("block"), F.col("c_mktsegment").alias("block_name"), F.when((case == 7) | ((case == 2) & (kind == 4)), 99).otherwise(3).alias("page"), baseline.alias("baseline_page"),
        roster.alias("roster_id"), F.when(case == 2, "elsewhere").otherwise(own).alias("source_id"), codes.alias("codes"), F.when(case == 10, "not_stated").alias("codes_state"), relation.alias("relation"))
    nations = load(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("members"))
    rosters = nations.select(F.concat(F.lit("n"), "c_nationkey").alias("roster_id"), F.lit(3).alias("pages"), "members")
    amendments = nations.select(F.concat(F.lit("n"), "c_nationkey").alias("roster_id"), F.concat(F.lit("a"), "c_nationkey").alias("source_id"), F.lit(5).alias("pages"))
    # The records are stored as a user's would be; the expressions that make them up do not mix with the rules.
    return validate.each_violation(validate.record_violations(cut(records), rosters, amendments), ["k"])


@query("box_violations", """
WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity::INT % 7 AS c FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, unnest([CASE WHEN c = 1 THEN 'box_count' END, CASE WHEN c = 2 THEN 'box_shape' END, CASE WHEN c = 2 OR c = 3 THEN 'box_range' END, CASE WHEN c IN (1, 4) THEN 'box_columns' END,
 CASE WHEN c IN (2, 3, 5) THEN 'box_row' END]) AS rule FROM b)
SELECT l_orderkey, l_linenumber, rule FROM r WHERE rule IS NOT NULL
""")
def _(spark, d):
    case, at = F.col("l_quantity").cast("int") % 7, (F.col("l_partkey") % 7).cast("int")
    edges = list(zip(validate.COLUMN_EDGES[:-1], validate.COLUMN_EDGES[1:]))
    top = (F.col("l_linenumber") * 20).cast("double")

    def box(i, x0, x1):
        hit = at == i
        left = F.when((case == 4) & hit, F.lit(x0 + 5.0)).otherwise(F.lit(float(x0)))
        bottom = F.when((case == 3) & hit, F.lit(700.0)).when((case == 5) & hit, top + 14).when((case == 2) & hit, F.lit(None).cast("double")).otherwise(top + 10)
        return F.array(left, top, F.lit(float(x1)), bottom)

    boxes = F.array(*[box(i, x0, x1) for i, (x0, x1) in enumerate(edges)])
    rows = load(spark, d, "lineitem").withColumn("boxes", F.when(case == 1, F.slice(boxes, 1, 6)).otherwise(boxes))
    return validate.each_violation(validate.with_violations(rows, validate.box_rules(F.col("boxes"))), ["l_orderkey", "l_linenumber"])


@query("publication_gate", """
SELECT l_orderkey AS publication, count(*) AS row_count, count(*) FILTER (l_quantity > 48) AS broken_rows,
 count(*) FILTER (l_quantity > 48) = 0 AS accepted FROM lineitem GROUP BY 1
""")
def _(spark, d):
    lines = load(spark, d, "lineitem").withColumn("publication", F.col("l_orderkey"))
    checked = validate.with_violations(lines, {"quantity": F.col("l_quantity") <= 48})
    return validate.publication_gate(checked, ["publication"])


@query("membership_keys", """
SELECT c_custkey AS list_number, left(sha256(to_json(['registry', '2026-2027', 'secondary-lists',
 lpad(c_nationkey::VARCHAR, 4, '0') || 'A01', c_mktsegment, lpad(c_custkey::VARCHAR, 8, '0')])::VARCHAR), 32) AS membership_id FROM customer
""")
def _(spark, d):
    listed = members(spark, d)
    return listed.select("list_number", membership_key(
        "registry", F.lit("2026-2027"), F.lit("secondary-lists"),
        F.concat(F.lpad(F.col("specialty").cast("string"), 4, "0"), F.lit("A01")), F.col("block"),
        F.lpad(F.col("list_number").cast("string"), 8, "0")).alias("membership_id"))


@query("membership_uniqueness", """
SELECT o_custkey AS list_number, o_orderpriority AS block, count(*) AS copies FROM orders GROUP BY 1, 2 HAVING count(*) > 1
""")
def _(spark, d):
    orders = load(spark, d, "orders").select(F.col("o_custkey").alias("list_number"), F.col("o_orderpriority").alias("block"))
    return validate.unique_key_gate(orders, ["list_number", "block"])


@query("validation_report", """
SELECT (SELECT count(*) FROM customer) AS ranked, (SELECT count(*) FROM orders) AS awards,
 (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) AS total,
 (SELECT count(DISTINCT k) FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT o_custkey FROM orders)) AS distinct_members
""")
def _(spark, d):
    listed = members(spark, d).select("list_number", F.lit("list").alias("record_type"))
    awards = load(spark, d, "orders").select(F.col("o_custkey").alias("list_number"), F.lit("award").alias("record_type"))
    # Distinct ids through a first grouping: the exact count is then an ordinary sum.
    per_member = listed.unionByName(awards).groupBy("list_number").agg(
        F.count_if(F.col("record_type") == "list").alias("l"), F.count(F.lit(1)).alias("n"))
    return per_member.agg(F.sum("l").alias("ranked"), F.sum(F.col("n") - F.col("l")).alias("awards"),
                          F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_members"))


@query("public_projection", """
SELECT left(sha256(concat_ws('|', c_nationkey, c_mktsegment, c_custkey, upper(c_name))), 32) AS id, c_nationkey AS specialty,
 c_mktsegment AS block, c_custkey AS list_number, upper(c_name) AS search_name FROM customer
""")
def _(spark, d):
    # Allow-list: the account balance and any later column never pass through.
    name = fold_upper(F.col("name"))
    return members(spark, d).select(
        short_id(F.concat_ws("|", "specialty", "block", F.col("list_number").cast("string"), name), 32).alias("id"),
        "specialty", "block", "list_number", name.alias("search_name"))


@query("observed_manifest", """
WITH p AS (SELECT l_suppkey AS document, l_linenumber AS page, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT document, count(*) AS pages, CAST(sum(n) AS BIGINT) AS row_count, array_to_string(list(n ORDER BY page), ',') AS page_row_counts FROM p GROUP BY 1
""")
def _(spark, d):
    lines = load(spark, d, "lineitem")
    per_page = lines.groupBy(F.col("l_suppkey").alias("document"), F.col("l_linenumber").alias("page")).agg(
        F.count(F.lit(1)).alias("n"))
    # One entry per printed page of a document, after the rows are counted.
    return per_page.groupBy("document").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("n").alias("row_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "n"))), lambda p: p["n"].cast("string")),
                     ",").alias("page_row_counts"))


@query("section_conflicts", """
SELECT l_orderkey AS section, count(DISTINCT l_linestatus) AS names FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1
""")
def _(spark, d):
    # Distinct by grouping twice: no set is built per section.
    names = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("section"), "l_linestatus").agg(F.count(F.lit(1)))
    return names.groupBy("section").agg(F.count(F.lit(1)).alias("names")).where("names > 1")


@query("count_reconciliation", """
WITH c AS (SELECT l_orderkey AS k, count(*) AS observed FROM lineitem GROUP BY 1),
e AS (SELECT o_orderkey AS k, o_orderkey % 7 + 1 AS expected FROM orders)
SELECT coalesce(c.k, e.k) AS document, observed, expected, observed IS NOT DISTINCT FROM expected AS matches FROM c FULL JOIN e ON c.k = e.k
""")
def _(spark, d):
    counts = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("document")).agg(F.count(F.lit(1)).alias("observed"))
    manifest = load(spark, d, "orders").select(F.col("o_orderkey").alias("document"), (F.col("o_orderkey") % 7 + 1).alias("expected"))
    return validate.manifest_gate(counts, manifest, ["document"], "observed", "expected")


@query("section_coverage", """
WITH s AS (SELECT l_suppkey AS document, l_linenumber AS first_page, max(CASE WHEN l_suppkey % 3 = 0 AND l_linenumber = 2 THEN 2 ELSE 1 END) AS pages,
  max(7) AS page_count FROM lineitem GROUP BY ALL),
g AS (SELECT *, first_page = coalesce(lag(first_page + pages) OVER (PARTITION BY document ORDER BY first_page, first_page + pages), 1) AS ok FROM s)
SELECT document, count(*) FILTER (NOT ok) AS gaps, max(first_page + pages) - 1 AS last_page, max(page_count) AS page_count,
 count(*) FILTER (NOT ok) = 0 AND max(first_page + pages) - 1 = max(page_count) AS complete FROM g GROUP BY 1
""")
def _(spark, d):
    long_page = F.when((F.col("l_suppkey") % 3 == 0) & (F.col("l_linenumber") == 2), 2).otherwise(1)
    sections = load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("document"), F.col("l_linenumber").alias("first_page")).agg(
        F.max(long_page).alias("pages"), F.lit(7).alias("page_count"))
    return validate.section_coverage(sections, "document", "first_page", "pages", "page_count")


@query("proven_inclusions", """
WITH i AS (SELECT c_nationkey AS specialty, c_mktsegment AS block, c_custkey * 10 + 5 AS list_number, c_custkey * 10 AS stated_before,
  10 * CASE WHEN c_custkey % 4 = 0 THEN c_custkey + 1 ELSE lead(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) END AS stated_after FROM customer),
n AS (SELECT c_custkey * 10 + 5 AS list_number, 10 * lead(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS a FROM customer)
SELECT i.*, stated_before AS number_before, a AS number_after, CASE WHEN stated_after = a THEN 'proven' ELSE 'neighbours_differ' END AS verdict FROM i JOIN n USING (list_number)
""")
def _(spark, d):
    listed = members(spark, d)
    following = ranking.neighbours(listed, ["specialty", "block"], [F.col("list_number")], "list_number")
    number = F.col("list_number")
    inclusions = following.select(
        "specialty", "block", (number * 10 + 5).alias("list_number"), (number * 10).alias("stated_before"),
        (F.when(number % 4 == 0, number + 1).otherwise(F.col("number_after")) * 10).alias("stated_after"))
    scaled = listed.withColumn("list_number", number * 10)
    return ranking.check_inclusions(scaled, inclusions, ["specialty", "block"], "list_number", "stated_before", "stated_after")
