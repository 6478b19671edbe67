"""Queries for search, facets, sorting and paging over parts, customers, orders and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pubtrack.functions import text
from pubtrack.operators import filters, index, ranking, search
from pubtrack.operators.scan import ordered_scan, rank
from pubtrack.plans.registry import query
from pubtrack.session import checkpoint_dir, load, spread


@query("folded_text", """
SELECT doc_id, sha256(lower(strip_accents(text))) AS folded_sha256 FROM documents
""")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", F.sha2(text.fold(F.col("text")), 256).alias("folded_sha256"))


@query("exact_fold", """
SELECT doc_id, sha256(trim(regexp_replace(upper(replace(strip_accents(text || ' M' || chr(170) || ' 1' || chr(186) || ' ' || chr(241)), 'ß', 'ss')), '\\s+', ' ', 'g')).replace(chr(170), 'A').replace(chr(186), 'O')) AS folded_sha256 FROM documents
""")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", F.sha2(text.fold_exact(F.concat("text", F.lit(" Mª 1º ñ"))), 256).alias("folded_sha256"))


@query("query_tokens", """
SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(p_name), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), '|') AS words,
 length(regexp_replace(p_name, '[^\\p{L}\\p{N}]', '', 'g')) >= 3 AS searchable FROM part
""")
def _(spark, d):
    return load(spark, d, "part").select("p_partkey", F.array_join(text.tokens(text.fold(F.col("p_name"))), "|").alias("words"),
                                         (text.alphanumerics(F.col("p_name")) >= 3).alias("searchable"))


@query("trigram_postings", """
WITH g AS (SELECT DISTINCT p_partkey, substr(lower(p_name), i, 3) AS gram FROM part, unnest(range(1, length(p_name) - 1)) AS u(i))
SELECT gram, count(*) AS posting_size FROM g GROUP BY 1
""")
def _(spark, d):
    parts = load(spark, d, "part").select("p_partkey", text.fold(F.col("p_name")).alias("name"))
    return search.gram_sizes(search.postings(parts, "p_partkey", "name"))


@query("document_postings", """
WITH c AS (SELECT doc_id, string_split(lower(strip_accents(text)), '') AS ch FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ch) - 1), lambda i: ch[i] || ch[i + 1] || ch[i + 2])) AS gram FROM c)
SELECT gram, count(*) AS posting_size FROM g GROUP BY 1
""")
def _(spark, d):
    folded = load(spark, d, "documents").select("doc_id", text.fold(F.col("text")).alias("t"))
    return search.gram_sizes(search.postings(folded, "doc_id", "t"))


@query("index_backfill", """
SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 47)
""")
def _(spark, d):
    indexed = load(spark, d, "lineitem").where("l_quantity > 47").select(F.col("l_partkey").alias("p_partkey"))
    return search.missing_postings(load(spark, d, "part"), indexed, "p_partkey").select("p_partkey")


SENTENCES = """
WITH q0 AS (SELECT DISTINCT lower(strip_accents(trim(unnest(regexp_split_to_array(text, '[.,\\n]+'))))) AS query FROM benchmark),
q1 AS (SELECT *, list_filter(regexp_split_to_array(query, '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS words FROM q0),
q AS (SELECT *, CASE WHEN length(regexp_replace(query, '[^\\p{L}\\p{N}]', '', 'g')) < 3 OR regexp_matches(query, '[%_\\\\]') THEN 'invalid'
  WHEN regexp_full_match(query, '\\d{7,8}') THEN 'number' WHEN len(list_filter(words, lambda w: length(w) >= 3)) = 0 THEN 'too_short' ELSE 'name' END AS kind FROM q1),
d AS (SELECT doc_id, lang, lower(strip_accents(text)) AS t FROM documents),
c AS (SELECT query, words, doc_id, lang, t FROM q JOIN d ON kind = 'name' AND len(list_filter(words, lambda w: length(w) >= 3 AND NOT contains(t, w))) = 0),
v AS (SELECT *, len(list_filter(words, lambda w: (length(t) - length(replace(t, w, ''))) / length(w) < len(list_filter(words, lambda o: o = w)))) = 0 AS ok FROM c)
"""


def benchmark_queries(spark, d, scope=None):
    pieces = load(spark, d, "benchmark").select(F.explode(F.split("text", r"[.,\n]+")).alias("piece"))
    sentences = pieces.select(text.fold(F.trim("piece")).alias("query")).distinct()
    if scope is not None:
        sentences = sentences.withColumn("lang", scope)
    return search.parse_queries(sentences.withColumn("query_id", F.col("query")), "query_id", "query", keep=["lang"] if scope is not None else ())


def batch(spark, d, broad=None, broadcast_rows=search.BROADCAST_ROWS, scope=None, skip=0):
    documents = spread(load(spark, d, "documents").select("doc_id", "lang", "text"), "doc_id")
    corpus = documents.select("doc_id", "lang", text.fold(F.col("text")).alias("t"))
    return search.search_names(corpus, "doc_id", "t", benchmark_queries(spark, d, scope), "query_id", [F.col("lang"), F.col("doc_id")],
                               broad=broad, broadcast_rows=broadcast_rows, scope=None if scope is None else "lang", skip=skip)


@query("batch_search", SENTENCES + """
, r AS (SELECT query AS query_id, doc_id, lang, CAST(row_number() OVER (PARTITION BY query ORDER BY lang, doc_id) AS INTEGER) AS position FROM v WHERE ok)
SELECT * FROM r WHERE position <= 20
""")
def _(spark, d):
    return batch(spark, d)[0].select("query_id", "doc_id", "lang", "position")


@query("indexed_search", SENTENCES + """
, r AS (SELECT query AS query_id, doc_id, lang, CAST(row_number() OVER (PARTITION BY query ORDER BY lang, doc_id) AS INTEGER) AS position FROM v WHERE ok)
SELECT * FROM r WHERE position <= 20
""")
def _(spark, d):
    corpus = load(spark, d, "documents").select("doc_id", "lang", text.fold(F.col("text")).alias("t"))
    root = f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    # Two generations: documents with a label first, then all; the second adds only those that are not indexed.
    index.extend_index(corpus.join(load(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", "t", root, "g1")
    index.extend_index(corpus, "doc_id", "t", root, "g2")
    return index.indexed_search(spark, root, "doc_id", "t", benchmark_queries(spark, d), "query_id", [F.col("lang"), F.col("doc_id")]).select("query_id", "doc_id", "lang", "position")


@query("scoped_search", SENTENCES + """
, s AS (SELECT *, CASE length(query) % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END AS wanted FROM v),
r AS (SELECT query AS query_id, doc_id, lang, CAST(row_number() OVER (PARTITION BY query ORDER BY lang, doc_id) AS INTEGER) AS position FROM s WHERE ok AND (wanted IS NULL OR wanted = lang))
SELECT * FROM r WHERE position <= 20
""")
def _(spark, d):
    scope = F.when(F.length("query") % 3 == 0, "en").when(F.length("query") % 3 == 1, "de")
    return batch(spark, d, scope=scope)[0].select("query_id", "doc_id", "lang", "position")


@query("second_page_search", SENTENCES + """
, r AS (SELECT query AS query_id, doc_id, lang, CAST(row_number() OVER (PARTITION BY query ORDER BY lang, doc_id) AS INTEGER) AS position FROM v WHERE ok)
SELECT * FROM r WHERE position BETWEEN 21 AND 40
""")
def _(spark, d):
    # No broadcast: the arm for large query sets.
    return batch(spark, d, broadcast_rows=0, skip=20)[0].select("query_id", "doc_id", "lang", "position")


@query("batch_search_outcomes", SENTENCES + """
, n AS (SELECT query, count(*) AS candidates, count(*) FILTER (ok) AS matches FROM v GROUP BY 1)
SELECT q.query AS query_id, kind, coalesce(candidates, 0) AS candidates, CASE WHEN kind <> 'name' THEN kind WHEN candidates > 300 THEN 'too_broad' ELSE 'ok' END AS outcome,
 coalesce(matches > 20, false) AS more FROM q LEFT JOIN n ON n.query = q.query
""")
def _(spark, d):
    return batch(spark, d, broad=300)[1]


@query("rarest_gram", SENTENCES + """
, lw AS (SELECT query, w, row_number() OVER (PARTITION BY query ORDER BY length(w) DESC, w) AS n FROM (SELECT query, unnest(list_distinct(words)) AS w FROM q WHERE kind = 'name') WHERE length(w) >= 3),
g0 AS (SELECT query, n * 3 + k AS pos, substr(w, CASE k WHEN 0 THEN 1 WHEN 1 THEN (length(w) - 3) // 2 + 1 ELSE length(w) - 2 END, 3) AS gram FROM lw, (VALUES (0), (1), (2)) AS x(k)),
g1 AS (SELECT query, gram, min(pos) AS pos FROM g0 GROUP BY 1, 2), g AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY pos) AS o FROM g1),
s AS (SELECT gram, (SELECT count(*) FROM d WHERE contains(t, x.gram)) AS posting_size FROM (SELECT DISTINCT gram FROM g WHERE o <= 12) x)
SELECT query AS query_id, arg_min(gram, (posting_size, o)) AS gram, min(posting_size) AS posting_size FROM g JOIN s USING (gram) WHERE o <= 12 GROUP BY 1
""")
def _(spark, d):
    corpus = load(spark, d, "documents").select("doc_id", text.fold(F.col("text")).alias("t"))
    return search.rarest_gram(benchmark_queries(spark, d), "query_id", search.gram_sizes(search.postings(corpus, "doc_id", "t")))


@query("number_lookup", """
SELECT lpad(o_orderkey::VARCHAR, 8, '0') AS list_number, o_custkey, s_suppkey AS query_id FROM orders JOIN supplier ON s_suppkey * 7 = o_orderkey
""")
def _(spark, d):
    wanted = load(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), F.lpad((F.col("s_suppkey") * 7).cast("string"), 8, "0").alias("query"))
    corpus = load(spark, d, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("list_number"), "o_custkey")
    return search.search_numbers(corpus, "list_number", search.parse_queries(wanted, "query_id", "query"), "query_id").select("list_number", "o_custkey", "query_id")


@query("faceted_filter", """
SELECT p_partkey FROM part WHERE contains(lower(strip_accents(concat_ws(' ', p_name, p_brand, p_type))), 'ring')
 AND contains(lower(strip_accents(concat_ws(' ', p_name, p_brand, p_type))), 'econ') AND p_size = 11
""")
def _(spark, d):
    return filters.facet_filter(load(spark, d, "part"), ["p_name", "p_brand", "p_type"], filters.query_words("  RÍNG  Econ "),
                                {"p_size": 11, "p_brand": ""}).select("p_partkey")


@query("pruned_facets", """
WITH f AS (SELECT 'p_size' AS facet, s_nationkey::VARCHAR AS value FROM supplier UNION SELECT 'p_brand', 'Brand#' || s_suppkey FROM supplier)
SELECT facet, value FROM f WHERE (facet = 'p_size' AND value IN (SELECT p_size::VARCHAR FROM part)) OR (facet = 'p_brand' AND value IN (SELECT p_brand FROM part))
""")
def _(spark, d):
    suppliers = load(spark, d, "supplier")
    wanted = suppliers.select(F.lit("p_size").alias("facet"), F.col("s_nationkey").cast("string").alias("value")).union(
        suppliers.select(F.lit("p_brand"), F.concat(F.lit("Brand#"), F.col("s_suppkey").cast("string")))).distinct()
    return filters.prune_facets(wanted, load(spark, d, "part"), ["p_size", "p_brand"])


@query("saved_rows", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linestatus = 'O' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
""")
def _(spark, d):
    rows = load(spark, d, "lineitem").withColumn("status", F.when(F.col("l_linestatus") == "O", "approved").otherwise("draft"))
    favourites = load(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return filters.saved_rows(rows, favourites, "l_orderkey", "status").select("l_orderkey", "l_linenumber", "l_partkey")


@query("scope_picker", """
SELECT n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey WHERE contains(lower(n_name || ' ' || r_name), 'nation_1') AND contains(lower(n_name || ' ' || r_name), 'a')
""")
def _(spark, d):
    scopes = load(spark, d, "nation").join(F.broadcast(load(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return filters.facet_filter(scopes, ["n_name", "r_name"], filters.query_words("A nation_1"), {}).select("n_nationkey")


@query("facet_values", """
SELECT p_brand, arg_max(p_type, p_partkey) AS label FROM part GROUP BY 1
""")
def _(spark, d):
    return filters.facet_values(load(spark, d, "part"), "p_brand", "p_type", "p_partkey")


@query("ordered_facets", """
WITH f AS (SELECT p_brand, translate(arg_max(p_type, p_partkey), 'NO', 'ñÓ') || ' ' || (arg_max(p_partkey, p_partkey) % 12) AS label FROM part GROUP BY 1)
SELECT p_brand, label, row_number() OVER (ORDER BY replace(strip_accents(lower(replace(regexp_extract(label, '^[^0-9]*'), 'ñ', 'n~~'))), 'n~~', 'n' || chr(1000)), CAST(regexp_extract(label, '[0-9]+') AS INTEGER), p_brand) AS place FROM f
""")
def _(spark, d):
    labelled = load(spark, d, "part").withColumn("label_of", F.concat(F.translate("p_type", "NO", "ñÓ"), F.lit(" "), (F.col("p_partkey") % 12).cast("string")))
    return filters.ordered_facets(labelled, "p_brand", "label_of", "p_partkey")


@query("sorted_rows", """
SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS position FROM customer
""")
def _(spark, d):
    rows = load(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return filters.sorted_positions(rows, "c_mktsegment", False, "c_custkey").select("c_custkey", "position")


@query("natural_sort", """
WITH t AS (SELECT p_partkey, p_partkey % 6 AS w, CAST(substr(p_brand, 7) AS INTEGER) AS n, p_partkey % 2 AS pad FROM part)
SELECT p_partkey, row_number() OVER (ORDER BY list_extract([4, 2, 1, 3, 5, 1], 1 + w) DESC, n DESC, p_partkey) AS position FROM t
""")
def _(spark, d):
    # Names whose order by code point would differ: ñ after nz, accents ignored, digits by value and beyond any integer.
    words = F.array(*map(F.lit, ["Ñu", "Nz", "Nuzar", "ñandú", "Óz", "NÚZAR"]))
    name = F.concat(F.get(words, (F.col("p_partkey") % 6).cast("int")), F.lit(" "), F.when(F.col("p_partkey") % 2 == 0, "0" * 30).otherwise(""),
                    F.substring("p_brand", 7, 9), F.lit("0" * 25))
    return filters.sorted_positions(load(spark, d, "part").select("p_partkey", name.alias("name")), "name", True, "p_partkey").select("p_partkey", "position")


@query("result_pages", """
SELECT o_orderkey, position, (position - 1) // 25 + 1 AS page FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS position FROM orders)
""")
def _(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return filters.page_of(orders, ["o_orderpriority"], [F.col("o_orderdate"), F.col("o_orderkey")], 25).select("o_orderkey", "position", "page")


@query("clamped_pages", """
SELECT o_custkey, count(*) AS row_count, least(greatest(3, 1), greatest(CAST(ceil(count(*) / 4) AS BIGINT), 1)) AS page FROM orders GROUP BY 1
""")
def _(spark, d):
    counts = load(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("row_count"))
    return filters.clamp_page(counts, F.lit(3).cast("long"), "row_count", 4)


@query("keyset_page", """
SELECT c_mktsegment, c_nationkey, c_custkey FROM customer WHERE (c_mktsegment, coalesce(CASE WHEN c_custkey % 10 <> 0 THEN c_nationkey END, 2147483647), c_custkey) > ('FURNITURE', 20, 100)
ORDER BY c_mktsegment, coalesce(CASE WHEN c_custkey % 10 <> 0 THEN c_nationkey END, 2147483647), c_custkey LIMIT 21
""")
def _(spark, d):
    rows = load(spark, d, "customer")
    order = [F.col("c_mktsegment"), search.rank_key(F.when(F.col("c_custkey") % 10 != 0, F.col("c_nationkey"))), F.col("c_custkey")]
    page = filters.after_cursor(rows, order, [F.lit("FURNITURE"), F.lit(20), F.lit(100).cast("long")], 20)
    return page.select("c_mktsegment", "c_nationkey", "c_custkey")


@query("keyset_batch", """
WITH r AS (SELECT c_custkey, c_mktsegment, c_name, row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS n, count(*) OVER () AS all_rows FROM customer),
c AS (SELECT s_suppkey, n, all_rows, CASE s_nationkey % 5 WHEN 0 THEN 'stale' WHEN 1 THEN 'forged' ELSE 'ok' END AS outcome FROM supplier JOIN r ON s_suppkey = c_custkey)
SELECT c.s_suppkey, outcome, outcome = 'ok' AND c.n + 5 < c.all_rows AS more, CAST(r.n - c.n AS INTEGER) AS position, r.c_custkey FROM c LEFT JOIN r ON outcome = 'ok' AND r.n > c.n AND r.n <= c.n + 5
""")
def _(spark, d):
    rows = load(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_name")
    kind = F.col("s_nationkey") % 5
    known = load(spark, d, "supplier").join(rows, F.col("s_suppkey") == F.col("c_custkey")).withColumn("generation", F.when(kind == 0, "g1").otherwise("g2")).withColumn("query", F.lit("all"))
    signed = filters.sign_cursor(F.col("generation"), F.when(kind == 1, "other").otherwise("all"), [F.col("c_mktsegment"), F.col("c_custkey")])
    cursors = known.select("s_suppkey", "generation", "query", "c_mktsegment", "c_custkey", signed.alias("signature"))
    pages, outcomes = filters.keyset_pages(rows, ["c_mktsegment", "c_custkey"], cursors, "s_suppkey", "g2", 5)
    return outcomes.join(pages, "s_suppkey", "left").select("s_suppkey", "outcome", "more", "position", "c_custkey")


@query("next_page_append", """
SELECT c_custkey FROM customer
""")
def _(spark, d):
    rows = load(spark, d, "customer").select("c_custkey")
    return filters.next_pages(rows, rows.where("c_custkey < 700"), "c_custkey")


@query("token_multiset_match", """
SELECT doc_id, (length(t) - length(replace(t, 'tion', ''))) / 4 >= 2 AND contains(t, 'the') AS matches FROM (SELECT doc_id, lower(strip_accents(text)) AS t FROM documents)
""")
def _(spark, d):
    wanted = F.array(F.lit("tion"), F.lit("the"), F.lit("tion"))
    return load(spark, d, "documents").select("doc_id", text.contains_tokens(text.fold(F.col("text")), wanted).alias("matches"))


@query("display_titles", """
SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || substr(w, 2)), ' ') AS title FROM part
""")
def _(spark, d):
    return load(spark, d, "part").select("p_partkey", text.display_title(F.upper("p_name")).alias("title"))


@query("split_destinations", """
SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || substr(w, 2)), ' ') AS center,
 upper(p_type[1]) || lower(substr(p_type, 2)) AS municipality FROM part
""")
def _(spark, d):
    written = F.concat("p_name", F.lit(" ("), F.col("p_type"), F.lit(") · "), F.col("p_type"))
    return load(spark, d, "part").select("p_partkey", text.split_destination(written).alias("s")).select("p_partkey", "s.center", "s.municipality")


@query("body_and_language", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Secundaria' WHEN 1 THEN 'Música y artes escénicas' ELSE 'Otros cuerpos' END AS body,
 CASE left(p_type, 1) WHEN 'E' THEN 'Inglés' WHEN 'S' THEN 'Francés' ELSE 'Sin mención bilingüe' END AS language FROM part
""")
def _(spark, d):
    from pubtrack.operators.validate import BODIES, LANGUAGES, lookup
    code = F.when(F.col("p_size") % 4 == 0, "0590").when(F.col("p_size") % 4 == 1, "0594").otherwise("0000")
    mark = F.when(F.startswith("p_type", F.lit("E")), "I").when(F.startswith("p_type", F.lit("S")), "F").otherwise("0")
    return load(spark, d, "part").select("p_partkey", lookup(code, BODIES, "Otros cuerpos").alias("body"),
                                         lookup(mark, LANGUAGES, "Sin mención bilingüe").alias("language"))
