"""Row filters, facets, sorting and paging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubtrack.functions.text import contains_words, fold, spanish_key
from pubtrack.operators.scan import ordered_scan, rank, total


def query_words(text: str) -> Column:
    """Folded words of a query, as an array literal."""
    return F.filter(F.split(F.trim(fold(F.lit(text))), r"\s+"), lambda w: w != "")


def facet_filter(rows: DataFrame, text_columns: Sequence[str], words: Column, facets: Mapping[str, object]) -> DataFrame:
    """Every word inside the joined text columns, and every non-empty facet equal."""
    text = fold(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in text_columns]))
    rule = contains_words(text, words)
    for column, value in facets.items():
        if value not in (None, ""):
            rule = rule & (F.col(column).cast("string") == F.lit(str(value)))
    return rows.where(rule)


def prune_facets(filters: DataFrame, rows: DataFrame, facets: Sequence[str]) -> DataFrame:
    """Requested facet values (``facet``, ``value``) that exist in the data."""
    present = rows.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in facets])).alias("p")).select("p.*").distinct()
    return filters.join(present, ["facet", "value"], "left_semi")


def saved_rows(rows: DataFrame, favourites: DataFrame, identity: str, status: str) -> DataFrame:
    """Saved rows of approved or superseded publications."""
    return rows.where(F.col(status).isin("approved", "superseded")).join(favourites, identity, "left_semi")


def archive_filter(entries: DataFrame, words: Column, kind: str | None, body: str | None, course: str | None,
                   start: str | None, end: str | None, title: str = "title", author: str = "author", bodies: str = "bodies",
                   course_column: str = "course", date: str = "date", type_column: str = "type") -> DataFrame:
    """Archive entries by words, type, body or unknown body, course or unknown course, dates."""
    text = fold(F.concat(F.col(title), F.lit(" "), F.col(author)))
    rule = contains_words(text, words)
    if kind:
        rule = rule & (F.col(type_column) == kind)
    if body:
        rule = rule & (F.size(bodies) == 0 if body == "unknown" else F.array_contains(bodies, body))
    if course:
        unknown = F.coalesce(F.col(course_column).cast("string"), F.lit("")) == ""
        rule = rule & (unknown if course == "unknown" else F.col(course_column).cast("string") == course)
    if start:
        rule = rule & (F.to_date(date) >= F.lit(start).cast("date"))
    if end:
        rule = rule & (F.to_date(date) <= F.lit(end).cast("date"))
    return entries.where(rule)


def recent_or_unknown(rows: DataFrame, date: str, known: DataFrame, identity: str, today: Column, days: int = 14) -> DataFrame:
    """Rows to look at again: dated within the window, undated, or not known yet."""
    seen = known.select(identity).distinct().withColumn("_known", F.lit(True))
    met = rows.join(seen, identity, "left")
    recent = F.to_date(date).between(F.date_sub(today, days), today)
    return met.withColumn("should_check", F.coalesce(recent, F.lit(False)) | F.col(date).isNull() | F.col("_known").isNull()).drop("_known")


def pending_notice(notices: DataFrame, documents: DataFrame, status: str, document: str) -> DataFrame:
    """Notices whose reading failed or whose document is neither approved nor superseded."""
    done = documents.where(F.col("document_status").isin("approved", "superseded")).select(document).distinct()
    met = notices.join(done.withColumn("_done", F.lit(True)), document, "left")
    failed = F.col(status).isin("fetch_failed", "extraction_failed", "detected_not_read", "pending")
    return met.withColumn("pending", F.coalesce(failed, F.lit(False)) | F.col("_done").isNull()).drop("_done")


def facet_values(rows: DataFrame, key: str, label: str, position: str) -> DataFrame:
    """Distinct keys with the label seen last."""
    return rows.groupBy(key).agg(F.max_by(label, position).alias("label"))


def ordered_facets(rows: DataFrame, key: str, label: str, position: str) -> DataFrame:
    """:func:`facet_values` with their place in the Spanish order of the labels (ties: by key)."""
    found = facet_values(rows, key, label, position)
    return ordered_scan(found.withColumn("_order", spanish_key(F.col("label"))), [], [F.col("_order"), F.col(key)], [rank("place")]).drop("_order")


def sorted_positions(rows: DataFrame, key: str, descending: bool, tie: str, kind: str = "text") -> DataFrame:
    """Stable position of each row under Spanish number-aware text order or numeric order."""
    if kind == "text":
        order = spanish_key(F.col(key))
    else:
        order = F.col(key)
    if descending:
        # Ascending scans only: a descending key is its ascending rank counted from the end.
        first = ordered_scan(rows.select(order.alias("_k")).distinct(), [], [F.col("_k")], [rank("_r")])
        ranked = rows.withColumn("_k", order).join(first, "_k").withColumn("_o", -F.col("_r"))
        return ordered_scan(ranked, [], [F.col("_o"), F.col(tie)], [rank("position")]).drop("_k", "_r", "_o")
    return ordered_scan(rows, [], [order, F.col(tie)], [rank("position")])


def page_of(rows: DataFrame, scope: Sequence[str], order: Sequence[Column], size: int) -> DataFrame:
    """Page number and place on the page of every row; a page is then a plain filter."""
    ranked = ordered_scan(rows, scope, order, [rank("position")])
    return ranked.withColumn("page", F.floor((F.col("position") - 1) / size) + 1)


def clamp_page(counts: DataFrame, requested: Column, total: str, size: int) -> DataFrame:
    """Requested page limited to the existing ones."""
    pages = F.greatest(F.ceil(F.col(total) / size), F.lit(1))
    return counts.withColumn("page", F.least(F.greatest(requested, F.lit(1)), pages))


def after_cursor(rows: DataFrame, order: Sequence[Column], cursor: Sequence[Column], size: int) -> DataFrame:
    """Keyset page: rows after the cursor in order, one more than a page to detect a next page.
    The first comparison is repeated alone so that it can prune files."""
    key, limit = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]), F.struct(
        *[c.alias(f"k{i}") for i, c in enumerate(cursor)])
    return rows.where((order[0] >= cursor[0]) & (key > limit)).orderBy(*order).limit(size + 1)


def sign_cursor(generation: Column, query: Column, key: Sequence[Column]) -> Column:
    """Signature of a cursor: it holds for one generation, one query and one place only."""
    return F.sha2(F.to_json(F.struct(generation.alias("g"), query.alias("q"), *[k.alias(f"k{i}") for i, k in enumerate(key)])), 256)


def keyset_pages(rows: DataFrame, order: Sequence[str], cursors: DataFrame, identity: str, generation: str, size: int) -> tuple[DataFrame, DataFrame]:
    """The pages of many cursors in one job, and the outcome of every cursor.

    ``cursors`` has ``identity``, generation, query, the columns ``order`` (the key of the last row seen, in a total
    order of ``rows``) and signature. A cursor of another generation is ``stale``, one whose signature does not fit
    ``forged``, any other one ``ok``; only these get pages: identity, position (from 1) and the columns of the rows.
    The outcome tells whether ``more`` rows follow the page. The key need not be among the rows any more.

    Cursors are merged into the ordered rows, where the running count tells how many rows are before each of them; the
    rows of its page are then the next ``size`` ranks, an equality join on the rank.
    """
    fits = F.col("signature") == sign_cursor(F.col("generation"), F.col("query"), [F.col(c) for c in order])
    judged = cursors.withColumn("outcome", F.when(F.col("generation") != generation, "stale").when(~F.coalesce(fits, F.lit(False)), "forged").otherwise("ok"))
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(order)]
    asked = judged.where("outcome = 'ok'").select(*keys, F.col(identity).alias("_cursor"), F.lit(1).alias("_kind"))
    there = rows.select(*keys, F.lit(None).cast(asked.schema["_cursor"].dataType).alias("_cursor"), F.lit(0).alias("_kind"), F.struct("*").alias("_row"))
    merged = there.unionByName(asked, allowMissingColumns=True)
    counted = ordered_scan(merged, [], [*[F.col(f"_k{i}") for i in range(len(order))], F.col("_kind"), F.col("_cursor")],
                           [total("_rank", (F.col("_kind") == 0).cast("long"))], like=there)
    places = counted.where("_kind = 1").select(F.col("_cursor").alias(identity), F.col("_rank").alias("_before"))
    wanted = places.select(identity, "_before", F.explode(F.sequence(F.lit(1), F.lit(size + 1))).alias("position")).withColumn("_rank", F.col("_before") + F.col("position"))
    pages = wanted.join(counted.where("_kind = 0").select("_rank", "_row"), "_rank").select(identity, "position", "_row.*")
    further = pages.where(F.col("position") > size).select(identity, F.lit(True).alias("more"))
    outcomes = judged.select(identity, "outcome").join(further, identity, "left").withColumn("more", F.coalesce("more", F.lit(False)))
    return pages.where(F.col("position") <= size), outcomes


def next_pages(rows: DataFrame, loaded: DataFrame, identity: str) -> DataFrame:
    """Loaded rows followed by the new ones not loaded yet."""
    return loaded.unionByName(rows.join(loaded.select(identity), identity, "left_anti"))


def clean_preferences(values: Column, pattern: str, most: int) -> Column:
    """Well-formed distinct values in first-seen order, limited to ``most``."""
    return F.slice(F.array_distinct(F.filter(values, lambda v: F.coalesce(F.rlike(v, F.lit(pattern)), F.lit(False)))), 1, most)


def publication_context(publications: DataFrame, identity: str, current_id: Column) -> DataFrame:
    """Display flags: not the current publication any more, and archived copy available."""
    available = F.col("artifact_url").isNotNull() & (F.coalesce(F.col("evidence_status"), F.lit("")) != "original_unavailable")
    return publications.withColumn("historical", ~F.col(identity).eqNullSafe(current_id)).withColumn("copy_available", available)


def duration_label(duration: Column, status: Column) -> Column:
    """Stated duration, or whether the document states none or it was not read."""
    return F.coalesce(F.nullif(duration, F.lit("")), F.when(status == "absent", "not_stated").otherwise("not_extracted"))
