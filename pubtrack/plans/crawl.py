"""Queries over crawled pages: links, dates, titles, URL rules and the link graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from pubtrack.functions import urls, values
from pubtrack.operators import inventory
from pubtrack.plans.registry import query
from pubtrack.session import load
from pubtrack.sources import web

LINKS = """
WITH raw AS (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*"([^"]*)"[^>]*>[^<]*</a>', 1) AS h,
  regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*"[^"]*"[^>]*>([^<]*)</a>', 1) AS t FROM pages),
links AS (SELECT page_id, url, CAST(i - 1 AS INTEGER) AS position, replace(h[i], '&amp;', '&') AS link, replace(t[i], '&amp;', '&') AS label
  FROM raw, unnest(range(1, len(h) + 1)) AS u(i)),
targets AS (SELECT *, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link
  WHEN link LIKE '//%' THEN regexp_extract(url, '^([a-z]+:)', 1) || link
  WHEN link LIKE '/%' THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || link
  ELSE NULL END AS target FROM links)
"""


def links(spark, d):
    return web.page_links(load(spark, d, "pages"), "page_id", "url", "html")


@query("page_links", LINKS + """
SELECT page_id, CAST(position + 2 AS INTEGER) AS position, link, trim(regexp_replace(label, '\\s+', ' ', 'g')) AS label, target FROM targets
UNION ALL SELECT page_id, 0, '/plain' || page_id || '.pdf', 'Uno ó ó ó >', regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/plain' || page_id || '.pdf' FROM pages
UNION ALL SELECT page_id, 1, '/a?x=1&y=ñ', 'dos &nada;', regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/a?x=1&y=ñ' FROM pages
""")
def _(spark, d):
    # In front of every page: a commented-out anchor, an unquoted address, references, an unclosed anchor, a script.
    head = F.concat(F.lit('<!-- <a href="/gone.pdf">x</a> --><a title="a > b href=/no" href=/plain'), F.col("page_id").cast("string"),
                    F.lit(""".pdf>Uno &oacute; &#243; &#xF3; &gt;</a><a name=top>ancla</a><script>s = "<a href='/s'>s</a>";</script><A HREF='/a?x=1&amp;y=&ntilde;'>dos <b>&nada;</b></a>"""))
    pages = load(spark, d, "pages").withColumn("html", F.concat(head, "html"))
    return web.page_links(pages, "page_id", "url", "html").select("page_id", "position", "link", "label", "target")


CANON = """CASE WHEN regexp_extract({u}, '^[^?#]*//[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({u}, '^[^?#]*//[^/?#]*([^?#]*)', 1) END"""


@query("canonical_urls", """
WITH b AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages),
p AS (SELECT page_id, CASE WHEN contains(url, '?') THEN url || '&' ELSE url || '?' END || list_extract(['q=a+b&q=%41*~', 'q=a%20b&q=A%2a%7E', 'a-b=1&a=2&z', 'b=%C3%A9&a=&a', '&&c=%2Bx=y'], 1 + page_id % 5) || '#part' AS url FROM b),
q AS (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '') AS parts FROM p),
e AS (SELECT page_id, url, list_sort(list_transform(parts, lambda x: {'k': url_decode(replace(regexp_extract(x, '^[^=]*'), '+', ' ')), 'v': url_decode(replace(regexp_extract(x, '^[^=]*=(.*)$', 1), '+', ' '))})) AS named FROM q)
SELECT page_id, sha256(c) AS url_id, c AS canonical FROM (SELECT page_id,
 lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(url, '//([^/?#:]*)', 1)) || """ + CANON.format(u="url") + """
 || '?' || array_to_string(list_transform(named, lambda x: replace(url_encode(x.k), '%20', '+') || '=' || replace(url_encode(x.v), '%20', '+')), '&') AS c FROM e)
""")
def _(spark, d):
    more = F.array(*map(F.lit, ["q=a+b&q=%41*~", "q=a%20b&q=A%2a%7E", "a-b=1&a=2&z", "b=%C3%A9&a=&a", "&&c=%2Bx=y"]))
    bare = F.regexp_replace("url", "#.*$", "")
    url = F.concat(bare, F.when(F.contains(bare, F.lit("?")), "&").otherwise("?"), F.get(more, (F.col("page_id") % 5).cast("int")), F.lit("#part"))
    pages = load(spark, d, "pages").withColumn("url", url)
    return pages.select("page_id", urls.opaque_id(F.col("url")).alias("url_id"), urls.canonical_url(F.col("url")).alias("canonical"))


@query("allowed_urls", """
SELECT page_id, url LIKE 'https://%' AND (regexp_extract(url, '//([^/?#:]*)', 1) LIKE '%.example.org'
 OR regexp_extract(url, '//([^/?#:]*)', 1) LIKE '%.example.com') AND NOT regexp_matches(regexp_extract(url, '//([^/?#]*)', 1), '@')
 AND (regexp_extract(url, '//[^/?#]*:(\\d+)', 1) IN ('', '443')) AS allowed FROM pages
""")
def _(spark, d):
    rule = urls.allowed_url(F.col("url"), suffixes=[".example.org", ".example.com"], schemes=["https"])
    return load(spark, d, "pages").select("page_id", rule.alias("allowed"))


MARK_SQL = " OR ".join(f"contains(lower(html), '{m}')" for m in web.CHALLENGE_MARKERS)


@query("page_flags", f"""
SELECT page_id, {MARK_SQL} AS challenge, CASE WHEN page_id % 3 = 0 THEN DATE '2024-01-01' + (page_id % 28)::INTEGER END AS published_on,
 regexp_matches(html, '<h1[^>]*>[^<]*(?:relacion|listado)[^<]*vacantes sin cubrir') AS vacancy_title FROM pages
""")
def _(spark, d):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 28).cast("int")).cast("string")
    third = F.col("page_id") % 3
    stated = (F.when(third == 0, F.concat(F.lit('<meta property="article:published_time" content="'), day, F.lit('T09:00:00Z"><time datetime="'), day, F.lit('"></time>')))
              .when(third == 1, F.concat(F.lit('<time datetime="'), day, F.lit('"></time><time datetime="1999-01-01"></time>'))).otherwise(""))
    return load(spark, d, "pages").withColumn("html", F.concat(stated, "html")).select(
        "page_id", web.is_challenge(F.col("html")).alias("challenge"), web.published_date(F.col("html")).alias("published_on"),
        web.is_vacancy_title(web.page_title(F.col("html"))).alias("vacancy_title"))


@query("structured_dates", """
SELECT page_id, CASE WHEN page_id % 7 IN (0, 1, 2, 3, 4) THEN strftime(DATE '2024-01-01' + (page_id % 300)::INTEGER, '%Y-%m-%d') END AS stated FROM pages
""")
def _(spark, d):
    day = F.concat(F.lit('{"datePublished":"'), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 300).cast("int")).cast("string"), F.lit('"}'))
    kind = F.col("page_id") % 7
    data = (F.when(kind == 0, day).when(kind == 1, F.concat(F.lit('[{"name":"a"},7,'), day, F.lit("]")))
            .when(kind == 2, F.concat(F.lit('{"@graph":[{"x":1},{"datePublished":"soon"},'), day, F.lit("]}")))
            .when(kind == 3, F.concat(F.lit('{broken</script><script type="application/ld+json">'), day))
            .when(kind == 4, F.concat(F.lit("["), day, F.lit(',{"datePublished":"1999-01-01"}]')))
            .when(kind == 5, '{"@graph":[{"x":1}],"datePublished":"2024-01-01"}').otherwise('{"datePublished":null}'))
    html = F.concat(F.lit('<script type="application/ld+json">'), data, F.lit("</script>"), "html")
    return load(spark, d, "pages").select("page_id", web.structured_date(html).alias("stated"))


@query("pseudonymised_links", LINKS + """
SELECT page_id, position, sha256(lower(strip_accents(trim(regexp_replace(label, '\\s+', ' ', 'g'))))) AS title_sha256 FROM targets
""")
def _(spark, d):
    from pubtrack.functions.text import fold
    return links(spark, d).select("page_id", "position", F.sha2(fold(F.col("label")), 256).alias("title_sha256"))


def _rules_sql(column):
    arms = []
    for kind, alternatives in web.TITLE_RULES:
        either = " OR ".join("(" + " AND ".join(f"regexp_matches({column}, '{p}')" for p in alt) + ")" for alt in alternatives)
        arms.append(f"WHEN {either} THEN '{kind}'")
    return "CASE " + " ".join(arms) + " ELSE 'unclassified' END"


TITLE_WORDS = ["Listas definitivas de interinos", "Corrección de errores", "Vacantes sin cubrir", "Convocatoria urgente",
               "Adjudicación definitiva", "Lista provisional", "Listado complementaria", "Apertura de listas"]


@query("title_kinds", f"""
WITH t AS (SELECT o_orderkey, lower(strip_accents(list_extract([{", ".join("'" + w + "'" for w in TITLE_WORDS)}], 1 + o_orderkey % 8)
 || ' ' || o_orderpriority)) AS f FROM orders)
SELECT o_orderkey, {_rules_sql('f')} AS kind FROM t
""")
def _(spark, d):
    titles = F.array(*[F.lit(w) for w in TITLE_WORDS])
    title = F.concat(F.get(titles, (F.col("o_orderkey") % 8).cast("int")), F.lit(" "), F.col("o_orderpriority"))
    return load(spark, d, "orders").select("o_orderkey", web.classify_title(title).alias("kind"))


UPDATE_TITLES = ["Lista provisional y definitiva", "Relación PROVISIONAL", "Lista complementaria definitiva", "Corrección de la definitiva", "Lista definitiva", "Corrección"]


@query("roster_update_kinds", """
SELECT o_orderkey, list_extract(['unclassified', 'provisional', CASE WHEN b THEN 'baseline' ELSE 'supplement' END, CASE WHEN b THEN 'baseline' ELSE 'correction' END,
 CASE WHEN b THEN 'baseline' ELSE 'unclassified' END, 'unclassified'], 1 + w) AS kind FROM (SELECT o_orderkey, o_orderkey % 6 AS w, o_custkey % 2 = 0 AS b FROM orders)
""")
def _(spark, d):
    title = F.get(F.array(*map(F.lit, UPDATE_TITLES)), (F.col("o_orderkey") % 6).cast("int"))
    return load(spark, d, "orders").select("o_orderkey", web.update_kind(title, F.col("o_custkey") % 2 == 0).alias("kind"))


@query("document_title_kinds", f"""
WITH t AS (SELECT doc_id, lower(strip_accents(regexp_extract(text, '^[^\\n]*'))) AS f FROM documents)
SELECT doc_id, {_rules_sql('f')} AS kind FROM t
""")
def _(spark, d):
    title = F.regexp_extract("text", r"^[^\n]*", 0)
    return load(spark, d, "documents").select("doc_id", web.classify_title(title).alias("kind"))


@query("normalised_dates", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%SZ')
 WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 3 THEN strftime(ts, '%Y-%m-%d') END AS normalised FROM events
""")
def _(spark, d):
    kind = F.col("event_id") % 5
    written = (F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd"))
               .when(kind == 1, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
               .when(kind == 2, F.concat(F.lit("Mon, "), F.date_format("ts", "dd MMM yyyy HH:mm:ss"), F.lit(" +0000")))
               .when(kind == 3, F.concat(F.lit("Listado de "), F.date_format("ts", "dd/MM/yyyy")))
               .otherwise(F.concat(F.lit("sin fecha "), F.col("event_type"))))
    return load(spark, d, "events").select("event_id", values.any_date(written).alias("normalised"))


@query("feed_entries", """
SELECT page_id, CAST(CASE WHEN page_id % 4 <> 1 THEN 0 END AS INTEGER) AS position,
 CASE page_id % 4 WHEN 0 THEN 'unsafe_markup' WHEN 1 THEN 'empty_feed' WHEN 2 THEN 'undated_item' END AS rejected,
 CASE WHEN page_id % 4 = 3 THEN '2024-01-' || lpad((1 + page_id % 28)::VARCHAR, 2, '0') || 'T10:00:00Z' END AS published_at,
 CASE WHEN page_id % 4 IN (2, 3) THEN url END AS link FROM pages
""".replace("CASE WHEN page_id % 4 <> 1 THEN 0 END", "CASE WHEN page_id % 4 IN (2, 3) THEN 0 END"))
def _(spark, d):
    pages = load(spark, d, "pages")
    kind = F.col("page_id") % 4
    day = F.concat(F.lit("Tue, "), F.lpad((1 + F.col("page_id") % 28).cast("string"), 2, "0"), F.lit(" Jan 2024 10:00:00 GMT"))
    item = F.concat(F.lit("<item><title>t</title><link>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</link><pubDate>"),
                    F.when(kind == 2, "soon").otherwise(day), F.lit("</pubDate><content:encoded>x</content:encoded></item>"))
    body = F.concat(F.when(kind == 0, "<!DOCTYPE rss>").otherwise(""),
                    F.lit('<rss xmlns:content="urn:content"><channel><title>f</title>'),
                    F.when(kind == 1, "").otherwise(item), F.lit("</channel></rss>"))
    return web.feed_entries(pages.withColumn("body", body), "page_id", "body").select(
        "page_id", "position", "rejected", "published_at", "link")


EDGES = LINKS + """
, edges AS (SELECT page_id, regexp_extract(url, '//([^/?#:]*)', 1) AS parent, link AS item, url LIKE 'https:%' AS second,
  html_chars FROM targets JOIN (SELECT page_id AS pid, length(html) AS html_chars FROM pages) ON pid = page_id)
"""


def edges(spark, d):
    size = load(spark, d, "pages").select("page_id", F.length("html").alias("html_chars"))
    return links(spark, d).join(size, "page_id").select(
        "page_id", urls.host_of(F.col("url")).alias("parent"), F.col("link").alias("item"),
        F.startswith("url", F.lit("https:")).alias("second"), "html_chars")


@query("disappeared_documents", EDGES + """
, known AS (SELECT DISTINCT item, parent FROM edges), seen AS (SELECT DISTINCT item, parent FROM edges WHERE second),
complete AS (SELECT DISTINCT parent FROM edges WHERE second),
m AS (SELECT k.item, c.parent IS NOT NULL AS read, c.parent IS NOT NULL AND s.item IS NULL AS gone
 FROM known k LEFT JOIN complete c USING (parent) LEFT JOIN seen s ON s.item = k.item AND s.parent = k.parent)
SELECT item, count(*) AS parents, count(*) FILTER (read) AS read_parents, count(*) FILTER (gone) AS missing_parents,
 bool_and(read) AND bool_and(gone) AND item NOT IN (SELECT item FROM seen) AS missing_from_index FROM m GROUP BY 1
""")
def _(spark, d):
    e = edges(spark, d)
    again = e.where("second")
    return inventory.disappeared(e, again, again, "item", "parent")


@query("link_frontier", LINKS + """
, g AS (SELECT DISTINCT regexp_extract(url, '//([^/?#:]*)', 1) AS a, link AS b FROM targets
 UNION SELECT DISTINCT link, regexp_extract(url, '//([^/?#:]*)', 1) FROM targets),
s AS (SELECT DISTINCT regexp_extract(url, '//([^/?#:]*)', 1) AS n FROM pages WHERE url LIKE 'https://%.example.org%'),
d1 AS (SELECT DISTINCT b AS n FROM g WHERE a IN (SELECT n FROM s) AND b NOT IN (SELECT n FROM s)),
d2 AS (SELECT DISTINCT b AS n FROM g WHERE a IN (SELECT n FROM d1) AND b NOT IN (SELECT n FROM s) AND b NOT IN (SELECT n FROM d1))
SELECT n AS node, 0 AS depth FROM s UNION ALL SELECT n, 1 FROM d1 UNION ALL SELECT n, 2 FROM d2
""")
def _(spark, d):
    found = links(spark, d).select(urls.host_of(F.col("url")).alias("a"), F.col("link").alias("b"))
    graph = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seeds = load(spark, d, "pages").where("url LIKE 'https://%.example.org%'").select(urls.host_of(F.col("url")).alias("node"))
    return inventory.expand_frontier(seeds, graph, "node", "a", "b", 2)


@query("inventory_upsert", EDGES + """
, inv AS (SELECT item, CASE WHEN min(html_chars) % 2 = 0 THEN 'list' ELSE 'award' END AS kind, min(page_id) AS first_seen, max(page_id) AS last_seen
  FROM edges WHERE NOT second GROUP BY 1),
obs AS (SELECT item, CASE WHEN html_chars % 7 = 0 THEN 'provisional' WHEN html_chars % 2 = 0 THEN 'list' ELSE 'award' END AS kind, page_id FROM edges WHERE second),
f AS (SELECT item, min(kind) AS k0, max(kind) AS k1, min(page_id) AS s0, max(page_id) AS s1, bool_or(kind = 'provisional') AS provisional FROM obs GROUP BY 1),
r AS (SELECT coalesce(inv.item, f.item) AS item, CASE WHEN k0 IS NULL THEN kind WHEN k0 <> k1 THEN 'unclassified'
  WHEN kind IS NULL OR kind = k0 THEN k0 ELSE 'unclassified' END AS kind, k0 IS NULL AS unseen,
  least(first_seen, s0) AS first_seen, greatest(last_seen, s1) AS last_seen, coalesce(provisional, false) AS provisional_observed FROM inv FULL JOIN f ON inv.item = f.item)
SELECT item, kind, CASE WHEN unseen THEN 'not_observed' WHEN kind = 'unclassified' THEN 'uncertain' ELSE 'title_only' END AS classification_status,
 first_seen, last_seen, provisional_observed FROM r
""")
def _(spark, d):
    kinded = edges(spark, d).withColumn("kind", F.when(F.col("html_chars") % 2 == 0, "list").otherwise("award"))
    known = kinded.where("NOT second").groupBy("item").agg(
        F.when(F.min("html_chars") % 2 == 0, "list").otherwise("award").alias("kind"),
        F.min("page_id").alias("first_seen"), F.max("page_id").alias("last_seen"))
    kinded = kinded.withColumn("kind", F.when(F.col("html_chars") % 7 == 0, "provisional").otherwise(F.col("kind")))
    return inventory.upsert_inventory(known, kinded.where("second"), "item", "parent", "kind", "page_id")


@query("edge_union", EDGES + """
SELECT item, parent, min(page_id) AS first_seen, max(page_id) AS last_seen FROM edges GROUP BY 1, 2
""")
def _(spark, d):
    e = edges(spark, d)
    return inventory.merge_edges(e.where("NOT second"), e.where("second"), "item", "parent", "page_id")


@query("latest_check_per_source", """
WITH c AS (SELECT regexp_extract(url, '//([^/?#:]*)', 1) AS host, page_id % 3 AS form, page_id, length(html) AS size FROM pages)
SELECT sha256('https://' || host || '/list?a=' || CASE form WHEN 2 THEN '2' ELSE '1' END || '&q=x+y') AS source_id, max(page_id) AS last_check, arg_max(size, page_id) AS last_size, count(*) AS checks
FROM c GROUP BY 1
""")
def _(spark, d):
    # Two spellings of one address and one other address for every host.
    forms = F.array(F.lit("/list?q=x%20y&a=1#top"), F.lit("/list?a=1&q=x+y"), F.lit("/list?a=2&q=x+y"))
    address = F.concat(F.lit("https://"), F.upper(urls.host_of(F.col("url"))), F.get(forms, (F.col("page_id") % 3).cast("int")))
    pages = load(spark, d, "pages").withColumn("address", address)
    return pages.groupBy(urls.opaque_id(F.col("address")).alias("source_id")).agg(
        F.max("page_id").alias("last_check"), F.max_by(F.length("html").cast("long"), "page_id").alias("last_size"),
        F.count(F.lit(1)).alias("checks"))


@query("merged_notices", LINKS + """
, n AS (SELECT link, page_id * 1000 + position AS o, label, CASE WHEN page_id % 3 = 0 THEN '2024-01-01' WHEN page_id % 3 = 1 THEN '2024-01-01T10:00:00Z' END AS day,
 CASE WHEN page_id % 2 = 0 THEN url ELSE '' END AS pdf FROM targets)
SELECT sha256(link) AS notice_id, arg_min(trim(regexp_replace(label, '\\s+', ' ', 'g')), o) AS title,
 coalesce(arg_min(day, o) FILTER (length(day) > 10), arg_min(day, o) FILTER (day IS NOT NULL)) AS date,
 arg_max(pdf, o) FILTER (pdf <> '') AS pdf, count(*) AS sightings FROM n GROUP BY 1
""")
def _(spark, d):
    third = F.col("page_id") % 3
    notices = links(spark, d).select(
        "link", (F.col("page_id") * 1000 + F.col("position")).alias("o"), F.col("label").alias("title"),
        F.when(third == 0, "2024-01-01").when(third == 1, "2024-01-01T10:00:00Z").alias("date"),
        F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise("").alias("pdf"))
    return inventory.merge_notices(notices, F.sha2("link", 256), "o", "date", "pdf", "title")
