"""Revision history, sightings, retention, best-known evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubtrack.operators.scan import following, last_known, ordered_scan, top_per_key


def revisions(observations: DataFrame, identity: Sequence[str], digest: str, seen: str) -> DataFrame:
    """First sighting of each distinct content per id, numbered, with its validity interval. A
    content seen before does not open a new revision."""
    first = observations.groupBy(*identity, digest).agg(
        F.min(seen).alias("valid_from"), F.max(seen).alias("last_seen"), F.count(F.lit(1)).alias("sightings"))
    scanned = ordered_scan(first, identity, [F.col("valid_from"), F.col(digest)], [following("valid_to", F.col("valid_from"))])
    return scanned.withColumn("current", F.col("valid_to").isNull())


def sightings(observations: DataFrame, identity: Sequence[str], seen: str, attempted: Column) -> DataFrame:
    """First and last sighting and last attempt per id."""
    return observations.groupBy(*identity).agg(
        F.min(seen).alias("first_seen_at"), F.max(seen).alias("last_seen_at"),
        F.max(F.when(attempted, F.col(seen))).alias("attempted_at"))


def retention_candidates(records: DataFrame, scope: Sequence[str], identity: str, checked: str, protected: Column,
                         now: Column, keep: int = 2, days: int = 90) -> DataFrame:
    """Records that may be removed: of known age, older than ``days``, not protected and not
    among the ``keep`` newest of the scope. Unknown or future age never expires."""
    dated = records.where(F.col(checked).isNotNull() & (F.col(checked) <= now))
    newest = top_per_key(dated.select(*scope, identity, checked), scope,
                         [F.col(checked).desc(), F.col(identity).desc()], keep).select(identity)
    old = dated.where((F.col(checked) < now - F.make_dt_interval(F.lit(days))) & ~F.coalesce(protected, F.lit(False)))
    return old.join(newest, identity, "left_anti")


def keep_recent(runs: DataFrame, scope: Sequence[str], identity: str, started: str, now: Column, days: int = 30,
                most: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Runs of the last ``days`` and at most ``most`` per scope; and how many were discarded."""
    recent = runs.where(F.col(started) >= now - F.make_dt_interval(F.lit(days)))
    kept = top_per_key(recent, scope, [F.col(started).desc(), F.col(identity).desc()], most,
                       spread=F.col(identity)).drop("position")
    counts = runs.groupBy(*scope).agg(F.count(F.lit(1)).alias("_all")).join(
        kept.groupBy(*scope).agg(F.count(F.lit(1)).alias("_kept")), list(scope), "left")
    discarded = counts.select(*scope, (F.col("_all") - F.coalesce("_kept", F.lit(0))).alias("discarded_runs"))
    return kept, discarded


def weakest_link(checks: DataFrame, group: Sequence[str], stamp: str) -> DataFrame:
    """Oldest check of a group when every member has one; otherwise unknown."""
    return checks.groupBy(*group).agg(
        F.when(F.count(F.lit(1)) == F.count(stamp), F.min(stamp)).alias("checked_at"))


def latest_known_check(streams: Sequence[DataFrame], identity: Sequence[str], stamp: str, now: Column) -> DataFrame:
    """Latest check not after ``now`` over several evidence streams of the same id and hash."""
    union = streams[0].select(*identity, stamp)
    for stream in streams[1:]:
        union = union.unionByName(stream.select(*identity, stamp))
    return union.groupBy(*identity).agg(F.max(F.when(F.col(stamp) <= now, F.col(stamp))).alias("checked_at"))


def as_of_previous(facts: DataFrame, events: DataFrame, keys: Sequence[str], at: str, tie: str, value: str, name: str) -> DataFrame:
    """Latest event value at or before each fact, by one ordered scan over both tables."""
    left = facts.withColumn("_kind", F.lit(1))
    right = events.select(*keys, at, tie, F.col(value).alias("_value")).withColumn("_kind", F.lit(0))
    union = left.unionByName(right, allowMissingColumns=True)
    scanned = ordered_scan(union, keys, [F.col(at), F.col("_kind"), F.col(tie)],
                           [last_known(name, F.when(F.col("_kind") == 0, F.struct(F.col(at).alias("at"), F.col("_value").alias("value"))))])
    return scanned.where(F.col("_kind") == 1).select(*facts.columns, name)


def cached_fallback(wanted: DataFrame, fresh: DataFrame, cached: DataFrame, identity: Sequence[str], error: str,
                    recoverable: Sequence[str], stamp: str) -> DataFrame:
    """Fresh evidence if available, else cached evidence when the failure is recoverable."""
    f = fresh.groupBy(*identity).agg(F.max(stamp).alias("_fresh"))
    c = cached.groupBy(*identity).agg(F.max(stamp).alias("_cached"), F.count(F.lit(1)).alias("_copies"))
    met = wanted.join(f, list(identity), "left").join(c, list(identity), "left")
    status = (F.when(F.col("_fresh").isNotNull(), "fresh")
              .when(F.col("_copies").isNotNull() & F.col(error).isin(list(recoverable)), "cached").otherwise("unavailable"))
    return met.withColumn("source_status", status).withColumn(
        "origin_checked_at", F.when(status == "fresh", F.col("_fresh")).when(status == "cached", F.col("_cached"))
    ).drop("_fresh", "_cached", "_copies")
