"""Helpers shared by the operators of this subpackage: inputs, shared tables, spans, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubtrack.session import checkpoint_dir

#: White space of all word rules here: space and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Setting by which the shuffle files of a query go when it ends, not when the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    The files survive the loss of executors, cut the lineage, fix whatever order or identifier the
    rows had when they were written, and can be pruned by column. Nothing reads the shuffles behind them
    again, so these are removed at once.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Most bits of the filter of :func:`perhaps` (8 MB), and those of one of its rows.
FILTER_BITS, ROW_BITS = 1 << 26, 1 << 15


def perhaps(rows: DataFrame, key: str, wanted: DataFrame, count: int) -> DataFrame:
    """The rows whose ``key`` is among the ``count`` rows of ``wanted`` (one column, stored), and a few others: what a join with
    ``wanted`` need not shuffle goes.

    Every wanted key sets one of 16 bits a key, at most FILTER_BITS, which are broadcast; with more keys than these serve, more others pass.
    """
    bits, most = ROW_BITS, min(16 * count, FILTER_BITS)
    while bits < most:
        bits *= 2

    def place(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(bits)) + 1

    at = place(wanted.columns[0])
    held = wanted.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
    position = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    met = rows.join(F.broadcast(held), F.bitmap_bucket_number(place(key)) == F.col("_bucket"))
    return met.where(F.getbit(byte, (position % 8).cast("int")) == 1).select(*rows.columns)


def texts_of(documents: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """Only identity and text, so that no other column of the input can clash; a null text is empty."""
    return documents.select(F.col(identity).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def packed(rows: DataFrame) -> Column:
    """The whole row as one struct ``record``: columns of its own can then have any name."""
    return F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("record")


def slices(batches: Iterator[pa.RecordBatch], *texts: int | str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice has at most ``most`` bytes in its text columns beyond one row: what a task
    copies at a time stays small however long the texts of a batch are."""
    for batch in batches:
        sizes = sum(np.asarray(pa.compute.binary_length(batch.column(t)).fill_null(0), dtype=np.int64) for t in texts)
        at, size = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > at and size + n > most:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n
        if batch.num_rows > at:
            yield batch.slice(at)


def lean(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``step`` as a task that returns to the system what it has freed. Python workers outlive their tasks, and the allocators
    would keep it for them, beside whatever the executor does next."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
                pool.release_unused()

    return run


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def span_array(text: Column, pattern: str, left: bool = False) -> Column:
    """All leftmost non-overlapping matches as ``array<struct<start, end, value>>`` in code points; with ``left`` also the
    text since the second match before, in which U+0001 stands for matches.

    Spark gives no match positions, but the pieces between the matches (``split``) and the matches
    themselves come from the same scan, so running lengths are the positions. They are summed in blocks of about the
    square root of their number, so that no long array is copied for every match. Texts without a match cost a single search.
    """
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                        lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
    kind = "array<struct<start:int,end:int,value:string,gap:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found"))

    def step(state, piece):
        begin = state["at"] + F.length(piece["gap"])
        end = begin + F.coalesce(F.length(piece["value"]), F.lit(0))
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), piece["value"].alias("value"), piece["gap"].alias("gap")))
        return F.struct(end.alias("at"), F.when(piece["value"].isNull(), state["found"]).otherwise(F.concat(state["found"], one)).alias("found"))

    def summed(held):
        width = F.ceil(F.sqrt(F.size(held))).cast("int")
        numbers = F.sequence(F.lit(0), F.floor((F.size(held) - 1) / width).cast("int"))
        return let(F.transform(numbers, lambda k: F.aggregate(F.slice(held, k * width + 1, width), start, step)), shifted)

    def shifted(blocks):
        bases = F.aggregate(blocks, F.array(F.lit(0)), lambda done, block: F.concat(done, F.array(F.element_at(done, -1) + block["at"])))
        return let(bases, lambda base: F.flatten(F.transform(blocks, lambda block, k: F.transform(block["found"], lambda s: F.struct(
            (s["start"] + F.get(base, k)).alias("start"), (s["end"] + F.get(base, k)).alias("end"), s["value"].alias("value"), s["gap"].alias("gap"))))))

    def plain(spans):
        def fields(s, i):
            mark = F.lit("\x01")
            before = F.concat(F.when(i > 1, mark).otherwise(""), F.when(i > 0, F.concat(F.get(spans, i - 1)["gap"], mark)).otherwise(""), s["gap"])
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), *([before.alias("left")] if left else []))

        return F.transform(spans, fields)

    found = let(let(pieces, summed), plain)
    empty = f"array<struct<start:int,end:int,value:string{',left:string' if left else ''}>>"
    return F.coalesce(F.when(text.rlike(pattern), found).otherwise(F.lit(None).cast(empty)), F.array().cast(empty))


def span_text(kind: Column, start: Column, end: Column) -> Column:
    """``kind:start:end`` of one span."""
    return F.concat_ws(":", kind, start.cast("string"), end.cast("string"))


#: Edges that one task contracts.
TASK_EDGES = 1_000_000


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as stars around the least id of each of its components."""
    held = [(np.asarray(b.column("a")), np.asarray(b.column("b"))) for b in batches if b.num_rows]
    if not held:
        return
    ids, ends = np.unique(np.concatenate([np.concatenate(side) for side in zip(*held)]), return_inverse=True)
    a, b = ends[:len(ends) // 2], ends[len(ends) // 2:]
    label = np.arange(len(ids))
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(label, high[open_], low[open_])
        while not (label[label] == label).all():
            label = label[label]
    moved = label != np.arange(len(ids))
    yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable id of every id in undirected ``links`` (a, b): columns ``id``, ``component``.

    Slices of about TASK_EDGES edges are contracted to stars side by side; what is left between them is settled by
    alternating large-star and small-star steps. Each step only re-points edges to the least
    neighbour seen, so the number of edges never grows and a long chain shrinks geometrically.
    The neighbourhood of a popular id is aggregated before the shuffle and never gathered. The
    steps end when the edges are stars: no id has two ends and no end has an edge of its own.
    """
    edges = shared_table(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    parts = edges.count() // TASK_EDGES + 1
    edges = shared_table(edges.coalesce(parts).mapInArrow(lean(contracted), "a long, b long"), "star")
    while parts > 1 and not is_stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = shared_table(large.distinct(), "star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = shared_table(small.where("a <> b").distinct(), "star")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        edges.select(F.col("b"), F.col("b")).distinct())


def is_stars(edges: DataFrame) -> bool:
    """True when every ``a`` has one ``b`` and no ``b`` is an ``a``."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("out")).union(edges.select("b", F.lit(0)))
    degree = ends.groupBy("id").agg(F.sum("out").alias("out"), F.min("out").alias("least"))
    return degree.where("out > 1 OR (out = 1 AND least = 0)").isEmpty()
