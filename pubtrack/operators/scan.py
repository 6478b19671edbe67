"""Ordered scans (rank, running sum, last known value, lag, lead) that survive hot keys.

A window partitioned by a key runs each key in one task. Here (key, order) is cut into
*slices* at bounds from a sample, so a key with a third of all rows is spread over many
of them. Each slice is scanned locally; one summary row per (key, slice) carries the
result of the earlier slices.

Tables that the optimizer's statistics show to be small are one slice, hence one plain window.

The bounds are a subquery (the rows with the least hashes of key and order) and the slice of
a row is found in them by an expression, so nothing runs until the result is wanted, nothing
is stored in between, and the rows are shuffled once, by (key, slice); a following scan over
the same order finds them in place.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_KEY, _SLICE, _POS, _CARRY = "_key", "_slice", "_pos", "_carry"
#: Most slices, and sampled rows for each of them.
MOST_SLICES, SAMPLED = 1024, 16
#: Estimated size up to which a whole table is one slice: even a single key of all its rows is a small task then.
ONE_SLICE_BYTES = 16 << 20
#: Estimated bytes of a stored table that one shuffle partition takes.
PARTITION_BYTES = 4 << 20


@dataclass(frozen=True)
class Step:
    """One scanned column: ``kind`` applied to ``value`` in order within the key."""

    name: str
    kind: str
    value: Column | None = None


def rank(name: str) -> Step:
    """Ordinal position 1, 2, 3 ... within the key."""
    return Step(name, "rank")


def total(name: str, value: Column) -> Step:
    """Running sum including the current row (exact types only)."""
    return Step(name, "sum", value)


def last_known(name: str, value: Column) -> Step:
    """Latest non-null value up to and including the current row."""
    return Step(name, "last", value)


def known_before(name: str, value: Column) -> Step:
    """Latest non-null value before the current row."""
    return Step(name, "before", value)


def next_known(name: str, value: Column) -> Step:
    """Nearest non-null value from the current row onwards."""
    return Step(name, "next", value)


def previous(name: str, value: Column) -> Step:
    """Value of the preceding row, null for the first one."""
    return Step(name, "lag", value)


def following(name: str, value: Column) -> Step:
    """Value of the next row, null for the last one."""
    return Step(name, "lead", value)


def highest(name: str, value: Column) -> Step:
    """Running maximum including the current row."""
    return Step(name, "max", value)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of ``df``; nothing runs for it."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except ValueError:  # after many joins the estimate has more digits than Python reads
        return sys.maxsize


def partitions_for(table: DataFrame) -> int:
    """Shuffle partitions for the rows of a stored ``table``: PARTITION_BYTES of its estimated size each, not fewer than configured."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-estimated_bytes(table) // PARTITION_BYTES))


def dealt(df: DataFrame, partitions: int, *keys: str) -> DataFrame:
    """``df`` shuffled by ``keys`` to ``partitions``, if these are more than a shuffle has anyway."""
    if partitions <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(partitions, *keys)


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Add the key and the position within it as one column each."""
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    return df.withColumn(_KEY, key).withColumn(_POS, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))


def slice_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], like: DataFrame | None = None) -> DataFrame:
    """Number order-preserving slices over (keys, order). The bounds are drawn from ``like`` if it is cheaper to make and
    has the same keys and order: any bounds give the same result."""
    at = F.struct(_KEY, _POS)
    shaped = placed(df, keys, order)
    drawn = (shaped if like is None else placed(like, keys, order)).select(at.alias("at"))
    steps = [1]
    while steps[0] * 2 < min(MOST_SLICES, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))):
        steps.insert(0, steps[0] * 2)
    slices = 2 * steps[0]
    sample = drawn.orderBy(F.xxhash64("at"), "at").limit(SAMPLED * slices).agg(F.sort_array(F.collect_list("at")).alias("at"))
    bounds = sample.select(F.transform(F.sequence(F.lit(1), F.lit(slices - 1)), lambda i: F.get("at", (i * F.size("at") / slices).cast("int")))).scalar()

    # Binary search for the number of bounds that are not after the row, unrolled so that it is compiled.
    found = shaped.withColumn("_bounds", bounds).withColumn(_SLICE, F.lit(0))
    for step in steps:
        found = found.withColumn(_SLICE, F.col(_SLICE) + F.when(F.get("_bounds", F.col(_SLICE) + (step - 1)) <= at, step).otherwise(0))
    return found.drop("_bounds")


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[Column], steps: Sequence[Step], keep: bool = False,
                 like: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """Add one column per step to ``df``; ``order`` must be total and ascending within a key. ``like`` as in :func:`slice_rows`.
    Slices are shuffled to ``partitions`` where given (:func:`partitions_for`), so that a task's memory does not grow with the table.

    With ``keep`` the result stays sliced: a following scan over the same keys and order (also of
    a part of the rows) uses the slices as they are, without another range partitioning.
    """
    staged = df
    for i, step in enumerate(steps):
        if step.value is not None:
            staged = staged.withColumn(f"_v{i}", step.value)
    if _KEY in df.columns:
        sliced = staged
    else:
        small = estimated_bytes(df) <= ONE_SLICE_BYTES
        sliced = placed(staged, keys, order) if small else slice_rows(staged, keys, order, like)
        if partitions and not small:
            sliced = sliced.repartition(partitions, _KEY, _SLICE)
    parts = [_KEY, _SLICE] if _SLICE in sliced.columns else [_KEY]
    local = Window.partitionBy(*parts).orderBy(_POS)
    backward = Window.partitionBy(*parts).orderBy(F.col(_POS).desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    running = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = local.rowsBetween(Window.unboundedPreceding, -1)
    scanned, summary = sliced, [F.count(F.lit(1)).alias("_n")]
    for i, step in enumerate(steps):
        value = F.col(f"_v{i}")
        boxed = F.struct(value.alias("v"))
        expression, edge = {
            "rank": lambda v, b: (F.row_number().over(local).cast("long"), None),
            "sum": lambda v, b: (F.sum(v).over(running), F.sum(v)),
            "last": lambda v, b: (F.last(v, ignorenulls=True).over(running),
                                  F.max_by(v, F.when(v.isNotNull(), F.col(_POS)))),
            "before": lambda v, b: (F.last(v, ignorenulls=True).over(earlier),
                                    F.max_by(v, F.when(v.isNotNull(), F.col(_POS)))),
            "next": lambda v, b: (F.last(v, ignorenulls=True).over(backward),
                                  F.min_by(v, F.when(v.isNotNull(), F.col(_POS)))),
            "lag": lambda v, b: (F.lag(b).over(local), F.max_by(b, F.col(_POS))),
            "lead": lambda v, b: (F.lead(b).over(local), F.min_by(b, F.col(_POS))),
            "max": lambda v, b: (F.max(v).over(running), F.max(v)),
        }[step.kind](value, boxed)
        scanned = scanned.withColumn(f"_l{i}", expression)
        if edge is not None:
            summary.append(edge.alias(f"_e{i}"))
    kept = [c for c in (_KEY, _SLICE, _POS) if keep and c in sliced.columns]
    columns = [c for c in df.columns if c not in (_KEY, _SLICE, _POS)]
    if parts == [_KEY]:
        return scanned.select(*columns, *[(F.col(f"_l{i}.v") if step.kind in ("lag", "lead") else F.col(f"_l{i}")).alias(step.name) for i, step in enumerate(steps)], *kept)
    edges = sliced.groupBy(_KEY, _SLICE).agg(*summary)
    by_slice = Window.partitionBy(_KEY).orderBy(_SLICE)
    before = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(_KEY).orderBy(F.col(_SLICE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for i, step in enumerate(steps):
        edge = F.col(f"_e{i}")
        carried.append({
            "rank": lambda: F.sum("_n").over(before),
            "sum": lambda: F.sum(edge).over(before),
            "last": lambda: F.last(edge, ignorenulls=True).over(before),
            "before": lambda: F.last(edge, ignorenulls=True).over(before),
            "next": lambda: F.last(edge, ignorenulls=True).over(after),
            "lag": lambda: F.lag(edge).over(by_slice),
            "lead": lambda: F.lead(edge).over(by_slice),
            "max": lambda: F.max(edge).over(before),
        }[step.kind]().alias(f"{_CARRY}{i}"))
    carry = edges.select(_KEY, _SLICE, *carried)
    joined = scanned.join(carry, [_KEY, _SLICE])
    for i, step in enumerate(steps):
        mine, carry_in = F.col(f"_l{i}"), F.col(f"{_CARRY}{i}")
        joined = joined.withColumn(step.name, {
            "rank": lambda: mine + F.coalesce(carry_in, F.lit(0)),
            "sum": lambda: F.coalesce(mine + carry_in, mine, carry_in),
            "last": lambda: F.coalesce(mine, carry_in),
            "before": lambda: F.coalesce(mine, carry_in),
            "next": lambda: F.coalesce(mine, carry_in),
            "lag": lambda: F.coalesce(mine, carry_in)["v"],
            "lead": lambda: F.coalesce(mine, carry_in)["v"],
            "max": lambda: F.greatest(mine, carry_in),
        }[step.kind]())
    return joined.select(*columns, *[s.name for s in steps], *kept)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                spread: Column | None = None, name: str = "position") -> DataFrame:
    """First ``k`` rows of each key. Spark limits the rows inside each map task, before the shuffle,
    up to the ``k`` of ``spark.sql.optimizer.windowGroupLimitThreshold`` (set by ``build_session``). With
    ``spread`` a hot key is first cut to ``k`` rows in each of several shares."""
    if spread is not None:
        share = F.pmod(F.xxhash64(spread), F.lit(256))
        cut_first = Window.partitionBy(*keys, "_share").orderBy(*order)
        df = (df.withColumn("_share", share).withColumn("_cut", F.row_number().over(cut_first))
              .where(F.col("_cut") <= k).drop("_cut", "_share"))
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)
