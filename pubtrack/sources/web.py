"""Crawled pages and feeds: links, dates, challenge pages, titles."""

from __future__ import annotations

from collections.abc import Sequence
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubtrack.functions.text import fold, squeeze
from pubtrack.functions.urls import allowed_url, canonical_url, points_to_pdf, resolve_url
from pubtrack.functions.values import any_date, strict_date

#: What an HTML parser does not show as content.
HIDDEN = r"(?is)<!--.*?-->|<(script|style|template)\b.*?</\1\s*>"
#: An anchor up to its end, the next anchor or the end of the page; attribute values may hold a bracket.
ANCHOR = r"""(?is)<a(?=[\s/])(?:[^>"']|"[^"]*"|'[^']*')*+>.*?(?=</a\s*>|<a[\s/>]|\z)"""
ATTRIBUTE = r"""(?is)([^\s=>"'/]+)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)|[^\s=>"'/]+"""
REFERENCE = "&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"

# Markers of pages that ask the reader to prove being human.
CHALLENGE_MARKERS = [
    "cf-chl-", "challenges.cloudflare.com", "verifying your browser", "verify you are human",
    "checking your browser", "just a moment", "captcha.perfdrive.com", "radware captcha page",
    "verificacion de seguridad", "verificación de seguridad", "incapsula", "challenge-platform",
]
CHALLENGE_BYTES = 256_000


def unescape(text: Column) -> Column:
    """Named and numeric character references resolved; unknown ones stay."""
    def one(reference):
        body = F.regexp_extract(reference, REFERENCE, 1)
        point = F.when(F.rlike(body, F.lit("^#[0-9]")), F.substring(body, 2, 9).try_cast("long")).when(
            F.rlike(body, F.lit("^#[xX]")), F.conv(F.substring(body, 3, 9), 16, 10).try_cast("long"))
        valid = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, point)), 8, "0")), "UTF-32")
        names = F.create_map(*[F.lit(x) for name, code in name2codepoint.items() for x in (name, chr(code))], F.lit("apos"), F.lit("'"))
        return F.coalesce(F.replace(F.coalesce(char, F.element_at(names, body)), F.lit("\u00a0"), F.lit(" ")), reference)

    pieces = F.zip_with(F.split(text, REFERENCE, -1), F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), one),
                        lambda before, char: F.concat(before, F.coalesce(char, F.lit(""))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


def inner_text(markup: Column) -> Column:
    """Visible text of a fragment: tags dropped, entities resolved, white space collapsed."""
    return squeeze(unescape(F.regexp_replace(markup, r"<[^>]*>", " ")))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag, quoted or not, references resolved; null when it is absent."""
    inside = F.regexp_extract(tag, r"""(?is)^<[a-z0-9]+((?:[^>"']|"[^"]*"|'[^']*')*+)>""", 1)
    named = F.filter(F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(0)), lambda a: F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)) == name)
    raw = F.regexp_extract(F.get(named, F.lit(0)), r"""(?s)^[^\s=]+\s*=\s*(.*)$""", 1)
    return unescape(F.regexp_replace(raw, r"""(?s)^(["'])(.*)\1$""", "$2"))


def page_links(pages: DataFrame, identity: str, url: str, html: str, section: str | None = None) -> DataFrame:
    """One row per anchor with an address in page order: position, link, label and resolved address.
    Comments and scripts hold no anchors; addresses may be unquoted. ``section`` is a pattern whose first
    group is the part of the page to read."""
    part = F.col(html) if section is None else F.regexp_extract(html, section, 1)
    found = F.regexp_extract_all(F.regexp_replace(part, HIDDEN, ""), F.lit(ANCHOR), F.lit(0))
    read = F.transform(found, lambda a: F.struct(attribute(a, "href").alias("link"), inner_text(F.regexp_replace(a, r"""(?is)^<a(?:[^>"']|"[^"]*"|'[^']*')*+>""", "")).alias("label")))
    anchors = pages.select(identity, url, F.posexplode(F.filter(read, lambda a: a["link"].isNotNull())).alias("position", "_a"))
    return anchors.select(identity, url, "position", F.col("_a.link").alias("link"), F.col("_a.label").alias("label")).withColumn(
        "target", resolve_url(F.col(url), F.col("link")))


def document_links(links: DataFrame, hosts: Sequence[str], suffixes: Sequence[str] = ()) -> DataFrame:
    """Links to documents on allowed hosts, one per canonical address, first sighting kept."""
    kept = links.where(allowed_url(F.col("target"), hosts, suffixes) & points_to_pdf(F.col("target")))
    return kept.withColumn("document_id", F.sha2(canonical_url(F.col("target")), 256))


def published_date(html: Column) -> Column:
    """Publication day stated by the page; null unless all statements agree."""
    meta = F.concat(
        F.regexp_extract_all(html, F.lit(r'(?is)<meta[^>]*property\s*=\s*"article:published_time"[^>]*content\s*=\s*"([^"]*)"'), F.lit(1)),
        F.regexp_extract_all(html, F.lit(r'(?is)<meta[^>]*content\s*=\s*"([^"]*)"[^>]*property\s*=\s*"article:published_time"'), F.lit(1)))
    timed = F.regexp_extract_all(html, F.lit(r'(?is)<time[^>]*datetime\s*=\s*"([^"]*)"'), F.lit(1))
    days = F.array_distinct(F.array_compact(F.transform(F.concat(meta, timed), lambda v: strict_date(F.left(v, F.lit(10))))))
    return F.when(F.size(days) == 1, days[0])


def structured_date(html: Column) -> Column:
    """First publication date in linked-data scripts of the page: of the object itself, else of the first
    object of a list or of a graph that has one."""
    scripts = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))

    def stated(script):
        graph = F.get_json_object(script, "$['@graph'][*].datePublished")
        whole = F.when(F.get_json_object(script, "$['@graph']").isNull(), F.get_json_object(script, "$.datePublished"))
        several = F.coalesce(F.get_json_object(script, "$[*].datePublished"), graph)
        texts = F.regexp_extract_all(F.coalesce(several, F.lit("")), F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
        return F.coalesce(F.get(F.array_compact(F.transform(texts, any_date)), F.lit(0)), any_date(whole))

    return F.get(F.array_compact(F.transform(scripts, stated)), F.lit(0))


def is_challenge(html: Column) -> Column:
    """Access-challenge page: a marker within the first 256,000 bytes."""
    head = F.lower(F.substring(html.cast("binary"), 1, CHALLENGE_BYTES).cast("string"))
    return F.exists(F.array(*[F.lit(m) for m in CHALLENGE_MARKERS]), lambda m: F.contains(head, m))


def page_title(html: Column) -> Column:
    """Main heading, else document title, without markup."""
    heading = inner_text(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    return F.when(heading != "", heading).otherwise(inner_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def is_vacancy_title(title: Column) -> Column:
    """Title announces a list of open vacancies."""
    folded = F.replace(fold(title), F.lit("-"), F.lit(" "))
    phrases = ["vacantes sin cubrir", "secundaria", "otros cuerpos"]
    rule = F.rlike(folded, F.lit(r"\b(relacion|listado)\b"))
    for phrase in phrases:
        rule = rule & F.contains(folded, F.lit(phrase))
    return rule


# Title rules in order of precedence. Each entry is a kind with its alternatives;
# an alternative holds patterns that must all be found in the folded title.
TITLE_RULES = [
    ("unclassified", [["provisional", "definitiv"]]),
    ("provisional", [["provisional"]]),
    ("correction", [["correccion"], ["rectificacion"]]),
    ("closed_procedure", [["desiert"]]),
    ("reactivation", [["reactivacion"], ["reincorporacion"]]),
    ("cessation", [[r"\b(ceses?|bajas?|exclusion)\b"]]),
    ("award", [["adjudicacion|adjudicados|adjudicatarios", "definitiv"]]),
    ("supplement", [["complementaria"]]),
    ("baseline", [["list", "interin", "definitiv"]]),
    ("vacancies", [["vacantes"]]),
    ("opening", [["abiert"], ["apertura"]]),
    ("admission", [["definitiv", "admision|admitid|convocatoria"]]),
    ("procedure", [["urgente"], ["convocatoria"]]),
]
UPDATE_RULES = [
    ("unclassified", [["provisional", "definitiva"]]),
    ("provisional", [["provisional"]]),
    ("supplement", [["complementaria", "definitiva"]]),
    ("correction", [["correccion", "definitiva"]]),
]


def classify_title(title: Column, rules: Sequence[tuple[str, list[list[str]]]] = TITLE_RULES) -> Column:
    """Document kind by the first rule whose patterns are all found in the folded title."""
    folded, result = fold(title), None
    for kind, alternatives in rules:
        matched = F.lit(False)
        for patterns in alternatives:
            every = F.lit(True)
            for pattern in patterns:
                every = every & F.rlike(folded, F.lit(pattern))
            matched = matched | every
        result = F.when(matched, kind) if result is None else result.when(matched, kind)
    return result.otherwise("unclassified")


def update_kind(title: Column, is_baseline: Column) -> Column:
    """Kind of a roster document by its title; the known baseline document keeps its kind unless its title
    speaks of a provisional list or lacks the word for a definitive one."""
    kind = classify_title(title, UPDATE_RULES)
    settled = ~F.contains(fold(title), F.lit("provisional")) & F.contains(fold(title), F.lit("definitiva"))
    return F.when(is_baseline & settled, "baseline").otherwise(kind)


def feed_entries(feeds: DataFrame, identity: str, body: str) -> DataFrame:
    """Items of RSS bodies. Bodies with declarations of entities or document types are refused,
    as are feeds without items and items without a date; ``rejected`` says why."""
    schema = "channel struct<item: array<struct<title: string, link: string, pubDate: string, `content:encoded`: string>>>"
    unsafe = F.rlike(body, F.lit(r"(?i)<!(?:DOCTYPE|ENTITY)"))
    parsed = feeds.withColumn("_x", F.from_xml(F.when(~unsafe, F.col(body)), schema)).withColumn(
        "_items", F.coalesce(F.col("_x.channel.item"), F.array().cast(
            "array<struct<title: string, link: string, pubDate: string, `content:encoded`: string>>")))
    items = parsed.select(identity, unsafe.alias("_unsafe"), F.posexplode_outer("_items").alias("position", "_i"))
    day = any_date(F.col("_i.pubDate"))
    rejected = (F.when(F.col("_unsafe"), "unsafe_markup").when(F.col("position").isNull(), "empty_feed")
                .when(day.isNull(), "undated_item"))
    return items.select(identity, "position", F.col("_i.title").alias("title"), F.col("_i.link").alias("link"),
                        day.alias("published_at"), F.col("_i.`content:encoded`").alias("content"), rejected.alias("rejected"))
