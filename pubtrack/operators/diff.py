"""Comparison of successive publications with multiset semantics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pubtrack.functions.values import digest_parts, row_text, short_id
from pubtrack.operators.scan import last_known, ordered_scan, previous


def publication_totals(rows: DataFrame, publication: Sequence[str], quantity: str) -> DataFrame:
    """Row and place totals; a missing quantity counts as nothing."""
    return rows.groupBy(*publication).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(F.coalesce(F.col(quantity), F.lit(0)).cast("long")), F.lit(0).cast("long")).alias("places"),
    )


def _side_totals(rows: DataFrame, group: Sequence[str], quantity: str, position: str) -> DataFrame:
    # Fixed-width buffers only: the aggregation hashes and combines before the shuffle.
    return rows.groupBy(*group).agg(
        F.sum(F.coalesce(F.col(quantity), F.lit(0)).cast("long")).alias("_places"),
        F.count(F.lit(1)).alias("_rows"), F.min(position).alias("_first"))


def _changes(sides: DataFrame, group: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``sides`` holds pre-aggregated totals with ``_later``; one shuffle meets both sides."""
    def of(later: bool, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("_later") == later, F.col(column))), F.lit(0).cast("long"))

    def first(later: bool) -> Column:
        return F.min(F.when(F.col("_later") == later, F.col("_first")))

    met = sides.groupBy(*group).agg(
        of(False, "_places").alias("before"), of(True, "_places").alias("after"),
        of(False, "_rows").alias("before_rows"), of(True, "_rows").alias("after_rows"),
        F.coalesce(first(True), first(False)).alias("first_position"))
    kind = (F.when(F.col("before") == 0, F.lit("appeared")).when(F.col("after") == 0, F.lit("disappeared"))
            .otherwise(F.lit("quantity_changed")))
    return met.where(F.col("before") != F.col("after")).select(
        *group, short_id(row_text([F.col(k) for k in keys]), 24).alias("change_id"), kind.alias("kind"),
        "before", "after", (F.col("after") - F.col("before")).alias("delta"), "before_rows", "after_rows", "first_position")


def snapshot_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], quantity: str, position: str) -> DataFrame:
    """Quantity changes between two publications; equal totals are not reported. Absence in the
    later one is only ever reported as ``disappeared``. ``first_position`` names the representative
    row: the first of the later publication, else of the earlier one."""
    old = _side_totals(before, keys, quantity, position).withColumn("_later", F.lit(False))
    new = _side_totals(after, keys, quantity, position).withColumn("_later", F.lit(True))
    return _changes(old.unionByName(new), keys, keys)


def representative_rows(changes: DataFrame, rows: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Changes with the full row that stands for them; a null key part equals a null key part."""
    named = rows.select(*[F.col(c).alias(f"row_{c}") for c in rows.columns])
    rule = F.col(f"row_{position}") == F.col("first_position")
    for key in keys:
        rule = rule & F.col(f"row_{key}").eqNullSafe(F.col(key))
    return changes.join(named, rule, "left")


def snapshot_diff_series(rows: DataFrame, publication: str, keys: Sequence[str], quantity: str,
                         position: str) -> DataFrame:
    """Every publication of a table against the one before it, in one read of the table. The calendar of
    publications, one row each, is taken from the totals and ordered in one task."""
    totals = _side_totals(rows, [publication, *keys], quantity, position)
    # One small row per publication: what follows it, and whether anything precedes it.
    order = totals.select(publication).distinct()
    line = Window.orderBy(publication)
    calendar = order.select(publication, F.lead(publication).over(line).alias("_next"), F.lag(publication).over(line).isNotNull().alias("_compared"))
    # Each total takes part twice: as the later side of its own publication and as the earlier side
    # of the next. The table itself is read and aggregated once.
    placed = totals.join(calendar, publication)
    parts = F.array_compact(F.array(
        F.when(F.col("_compared"), F.struct(F.col(publication).alias("at"), F.lit(True).alias("later"))),
        F.when(F.col("_next").isNotNull(), F.struct(F.col("_next").alias("at"), F.lit(False).alias("later")))))
    sides = placed.withColumn("_part", F.explode(parts)).select(
        F.col("_part.at").alias(publication), *keys, "_places", "_rows", "_first", F.col("_part.later").alias("_later"))
    return _changes(sides, [publication, *keys], keys)


def previous_compatible(publications: DataFrame, identity: str, scope: str, course: str, published: str) -> DataFrame:
    """Latest earlier publication of the same scope whose course is equal or unknown on either
    side. Found by ordered scans, so no pair of publications is ever formed."""
    entry = F.struct(F.col(published).alias("at"), F.col(identity).alias("id"))
    order = [F.col(published), F.col(identity)]
    wide = ordered_scan(publications, [scope], order, [
        previous("_any", entry), last_known("_unknown", F.when(F.col(course).isNull(), entry))])
    same = ordered_scan(wide, [scope, course], order, [previous("_same", entry)])
    best = F.when(F.col(course).isNull(), F.col("_any")).otherwise(F.greatest("_same", "_unknown"))
    return same.select(*publications.columns, best["id"].alias("previous_id"), best["at"].alias("previous_published"))


def current_and_previous(publications: DataFrame, scope: Sequence[str], identity: str, process: str,
                         approved: Column, order: Sequence[Column]) -> DataFrame:
    """Latest approved publication and the latest approved one of another process."""
    rank = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(order)])
    keys = list(scope) or ["_all"]
    valid = publications.where(approved).withColumn("_all", F.lit(0))
    # Latest per process first: a group then holds one row per process.
    best = valid.groupBy(*keys, process).agg(F.max(rank).alias("_r"), F.max_by(identity, rank).alias("_id"))
    top = best.groupBy(*keys).agg(F.max_by("_id", "_r").alias("current_id"), F.max_by(process, "_r").alias("_p"))
    second = (best.join(top.select(*keys, "_p"), keys).where(F.col(process) != F.col("_p"))
              .groupBy(*keys).agg(F.max_by("_id", "_r").alias("previous_id")))
    return top.join(second, keys, "left").select(*scope, "current_id", "previous_id")


def semantic_digest(rows: DataFrame, publication: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Order-insensitive, duplicate-sensitive digest of each publication's rows."""
    text = row_text([F.col(c) for c in content])
    lanes = digest_parts(text)
    named = [p.alias(f"_d{i}") for i, p in enumerate(lanes)]
    joined = F.concat_ws(":", *[F.col(f"_d{i}").cast("string") for i in range(len(lanes))])
    return rows.groupBy(*publication).agg(*named).select(*publication, F.sha2(joined, 256).alias("semantic_sha256"))


def duplicate_groups(rows: DataFrame, cells: Sequence[str]) -> DataFrame:
    """Identical source rows: kept, counted and only warned about."""
    return rows.groupBy(*cells).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def multiset_difference(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose multiplicity differs between two collections, with both counts."""
    sides = left.select(*columns, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*columns, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    counted = sides.groupBy(*columns).agg(F.sum("_l").alias("left_count"), F.sum("_r").alias("right_count"))
    return counted.where(F.col("left_count") != F.col("right_count"))
