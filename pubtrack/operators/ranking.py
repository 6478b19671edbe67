"""Ordinal ranks, ordering proofs and reviewed amendments of ranked lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubtrack.functions.values import short_id
from pubtrack.operators.scan import following, last_known, next_known, ordered_scan, previous, rank


def ordinal_rank(rows: DataFrame, scope: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Running position within the scope (the whole table when ``scope`` is empty)."""
    return ordered_scan(rows, scope, order, [rank(name)])


def order_violations(rows: DataFrame, group: Sequence[str], position: Sequence[Column], number: str) -> DataFrame:
    """Rows whose number does not strictly increase in reading order within the group."""
    scanned = ordered_scan(rows, group, position, [previous("previous_number", F.col(number))])
    return scanned.where(F.col("previous_number") >= F.col(number))


def neighbours(rows: DataFrame, group: Sequence[str], order: Sequence[Column], number: str) -> DataFrame:
    """Each row with the numbers directly before and after it."""
    return ordered_scan(rows, group, order, [previous("number_before", F.col(number)),
                                             following("number_after", F.col(number))])


def check_insertions(baseline: DataFrame, insertions: DataFrame, group: Sequence[str], number: str) -> DataFrame:
    """Verdict per insertion: unknown block, number already present, bracketed or at an edge."""
    keys = list(group)
    repeated = insertions.groupBy(*keys, number).agg(F.count(F.lit(1)).alias("_copies"))
    wanted = repeated.select(*keys, number)
    listed = baseline.select(*keys, number).distinct()
    # Probes before and after each wanted number share one ordered scan with the list, so the
    # neighbours are found without pairing insertions and members.
    probes = (wanted.withColumn("_side", F.lit(0)).unionByName(listed.withColumn("_side", F.lit(1)))
              .unionByName(wanted.withColumn("_side", F.lit(2))))
    member = F.when(F.col("_side") == 1, F.col(number))
    near = ordered_scan(probes, keys, [F.col(number), F.col("_side")],
                        [last_known("_before", member), next_known("_after", member)])
    met = near.where(F.col("_side") != 1).groupBy(*keys, number).agg(
        F.max(F.when(F.col("_side") == 0, F.col("_before"))).alias("number_before"),
        F.max(F.when(F.col("_side") == 2, F.col("_after"))).alias("number_after"))
    judged = (repeated.join(met, [*keys, number])
              .join(listed.withColumn("_present", F.lit(True)), [*keys, number], "left")
              .join(listed.select(*keys).distinct().withColumn("_known", F.lit(True)), keys, "left"))
    verdict = (F.when(F.col("_copies") > 1, "repeated_insertion").when(F.col("_known").isNull(), "unknown_block")
               .when(F.col("_present"), "already_present")
               .when(F.col("number_before").isNotNull() & F.col("number_after").isNotNull(), "bracketed")
               .otherwise("edge"))
    return judged.select(*keys, number, "number_before", "number_after", verdict.alias("verdict"))


def apply_insertions(baseline: DataFrame, insertions: DataFrame, scope: str, block: str, block_order: Column,
                     number: str, name: str, source: str) -> DataFrame:
    """Place reviewed insertions by number inside their block and rank the scope again.

    Insertions that name an unknown block or a present number are left out; they are listed by
    :func:`check_insertions`, whose verdicts gate the publication.
    """
    verdicts = check_insertions(baseline, insertions, [scope, block], number)
    good = insertions.join(verdicts.where(F.col("verdict").isin("bracketed", "edge")).select(scope, block, number),
                           [scope, block, number], "left_semi")
    identity = F.concat_ws("|", scope, block, F.col(number).cast("string"), name)
    merged = baseline.withColumn("inserted", F.lit(False)).unionByName(
        good.withColumn("inserted", F.lit(True)), allowMissingColumns=True)
    merged = merged.withColumn("member_id", short_id(identity, 32))
    return ordinal_rank(merged, [scope], [block_order, F.col(number), F.col(source)])


def check_inclusions(baseline: DataFrame, inclusions: DataFrame, group: Sequence[str], number: str, before: str, after: str) -> DataFrame:
    """Verdict of inclusions that state their two neighbours: both must be adjacent members and
    stand around the number."""
    judged = check_insertions(baseline, inclusions, group, number)
    stated = inclusions.select(*group, number, before, after)
    met = stated.join(judged, [*group, number])
    proven = (F.col(before) == F.col("number_before")) & (F.col(after) == F.col("number_after"))
    return met.withColumn("verdict", F.when(F.col("verdict").isin("bracketed", "edge"), F.when(
        F.coalesce(proven, F.lit(False)), "proven").otherwise("neighbours_differ")).otherwise(F.col("verdict")))


def apply_corrections(baseline: DataFrame, changes: DataFrame, number: str, name: str, codes: str) -> tuple[DataFrame, DataFrame]:
    """Add one array element per reviewed change, sorted, with a reference back to the baseline.

    A change applies only when its name fits exactly one member, that member carries the stated
    number and the code is new. ``outcome`` tells what happened to every change.
    """
    # A popular name is reduced to its count and one member before it meets the changes.
    fits = baseline.groupBy(name).agg(F.count(number).alias("_matches"), F.max(number).alias("_number"), F.first(codes).alias("_codes"))
    sure = (F.col("_matches") == 1) & (F.col("_number") == F.col(number))
    judged = changes.join(fits, name, "left").select(
        "change_id", number, name, "code", F.coalesce("_matches", F.lit(0)).alias("name_matches"),
        F.when(sure, F.array_contains("_codes", F.col("code"))).alias("has_code"))
    outcome = (F.when((F.col("name_matches") != 1) | F.col("has_code").isNull(), "ambiguous_member")
               .when(F.col("has_code"), "already_present").otherwise("applied"))
    judged = judged.withColumn("outcome", outcome)
    applied = (judged.where(F.col("outcome") == "applied").groupBy(number)
               .agg(F.collect_set("code").alias("_added"), F.min("change_id").alias("first_change")))
    corrected = baseline.join(applied, number, "left").withColumn(
        codes, F.when(F.col("_added").isNull(), F.col(codes))
        .otherwise(F.array_sort(F.array_union(F.col(codes), F.col("_added")))))
    return corrected.withColumn("amended", F.col("_added").isNotNull()).drop("_added"), judged
