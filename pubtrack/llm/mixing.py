"""Mixing of sources to target weights by weighted fair queueing, in DataFrame functions only.

Every source is a queue of its documents in shuffled order, gone through up to ``repeat`` times. A
document's virtual finish time is the number of words its queue has served with it, divided by the
queue's target. Serving all queues in the order of finish times and stopping at the total budget gives
every source its target to within a document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pubtrack.llm.common import SPACE, packed, shared_table
from pubtrack.operators.scan import ordered_scan, rank
from pubtrack.session import small_side

WORD = rf"[^{SPACE}]+"
#: Hash digits that cut a queue into parts, and parts of the unit of finish time.
PART_DIGITS, TIME_PARTS = 3, 4096


def global_rank(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number the rows of ``df`` 0, 1, 2 ... in ``order``. Range partitions are numbered side by side;
    only their row counts, one row for each, meet in one task."""
    ranged = shared_table(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn(name, inside).join(offsets, "_part").withColumn(name, F.col(name) - 1 + F.col("_offset")).drop("_part", "_offset")


def targets(sources: DataFrame, weights: Sequence[int], budget: float, repeat: int) -> DataFrame:
    """Add ``target`` to ``sources`` (source, place, source_size): the share of ``budget`` times all words
    by weight, but at most ``repeat`` times the source's words, the excess shared again by weight.

    The level (words per unit of weight) at which the shares sum to the budget is found by raising it
    until no further source reaches its limit; each step is one aggregate that returns one row.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = shared_table(sources.withColumn("weight", weight), "sources")
    limit = (F.col("source_size") * repeat).cast("double")
    level, full = 0.0, -1
    while True:
        at_limit = F.lit(full >= 0) & (limit <= F.lit(level) * F.col("weight"))
        row = weighed.agg(F.sum("source_size").alias("all"), F.sum(F.when(at_limit, F.col("source_size"))).alias("used"),
                          F.sum(F.when(~at_limit, F.col("weight"))).alias("open"), F.count(F.when(at_limit, 1)).alias("full")).first()
        if row["full"] == full or not row["open"]:
            break
        full, level = row["full"], (budget * (row["all"] or 0) - repeat * (row["used"] or 0)) / row["open"]
    return weighed.withColumn("target", F.least(limit, F.lit(level) * F.col("weight")))


def mix_sources(documents: DataFrame, weights: Sequence[int] = (5, 2, 1), budget: float = 1.5, repeat: int = 2, seed: str = "mix",
                identity: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document row: doc_id, size, source, source_size, target, taken, times.

    ``times`` (0 to ``repeat``) is how often the mix holds the document and ``taken`` the words this
    gives. Sources take the weights in turn by code point, null last. Null and empty texts have no words
    and are never taken; repeated rows and identities are separate rows; an empty table gives no rows;
    other columns are not read. The order within a source is that of a digest of seed and identity (ties:
    by size and the order of the rows), so a rerun gives the same mix.

    A source's queue is cut into parts by the digest, and finish times into parts of time. Sums of
    parts carry over, so neither a source nor the whole is ever ordered in one task.
    """
    words = F.regexp_count("text", F.lit(WORD)).cast("long")
    rows = documents.select(F.col(identity).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                            F.col(source).cast("string").alias("source"))
    rows = shared_table(rows.select("doc_id", "source", words.alias("size"), F.monotonically_increasing_id().alias("row"),
                                    F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))).alias("digest")), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = targets(global_rank(sources, [F.col("source").asc_nulls_last()], "place"), weights, budget, repeat)
    aims = small_side(aims.select(F.col("source").alias("_source"), "place", "source_size", "target"))
    queued = rows.join(aims, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("part", F.left("digest", F.lit(PART_DIGITS)))

    sums = queued.groupBy("place", "part").agg(F.sum("size").alias("words"))
    before = sums.select("place", "part", F.coalesce(F.sum("words").over(
        Window.partitionBy("place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("place", "part").orderBy("digest", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    served = queued.withColumn("served", F.sum("size").over(inside)).join(before, ["place", "part"]).withColumn("served", F.col("served") + F.col("before"))
    served = shared_table(served.drop("part", "before"), "served")

    def finish(turn):
        return (F.col("served") + turn * F.col("source_size")) / F.when(F.col("target") > 0, F.col("target"))

    def place_of(turn):
        return F.struct(finish(turn).alias("finish"), F.col("place"), F.col("digest"), F.col("size"), F.col("row"))

    turns = served.where("size > 0").select("size", F.explode(F.array(*[place_of(turn) for turn in range(repeat)])).alias("at"))
    late = F.greatest(F.col("at.finish"), F.lit(1.0))
    time = F.floor(F.least(F.col("at.finish"), F.lit(1.0)) * TIME_PARTS) + F.floor(F.log2(late) * 64)
    timed = turns.withColumn("time", time)
    whole = int(budget * (served.agg(F.sum("size")).first()[0] or 0))
    sums = timed.groupBy("time").agg(F.sum("size").alias("words"))
    running = sums.select("time", F.sum("words").over(Window.orderBy("time")).alias("until"), "words")
    crossing = running.where(F.col("until") > whole).orderBy("time").first()
    if crossing is None:
        times = F.lit(repeat)
    else:
        left = whole - (crossing["until"] - crossing["words"])
        edge = timed.where(F.col("time") == crossing["time"]).withColumn("until", F.sum("size").over(
            Window.partitionBy("time").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        last = edge.where(F.col("until") > left).agg(F.min("at").alias("at")).first()["at"]
        cut = F.struct(*[F.lit(last[c]).cast(t).alias(c) for c, t in (("finish", "double"), ("place", "long"), ("digest", "string"), ("size", "long"), ("row", "long"))])
        times = sum((F.when(place_of(turn) < cut, 1).otherwise(0) for turn in range(repeat)), F.lit(0))
    times = F.when((F.col("size") > 0) & (F.col("target") > 0), times).otherwise(0)
    return served.select("doc_id", "size", "source", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"), times.alias("times"), "row")


def mixed_documents(documents: DataFrame, weights: Sequence[int] = (5, 2, 1), budget: float = 1.5, repeat: int = 2, seed: str = "mix",
                    identity: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every row as often as :func:`mix_sources` takes it, with all columns of ``documents``.

    Rows with equal identity, source and size are told apart by a number of their own: what was decided for all of
    them is dealt out evenly, so the mix holds exactly as many words as decided. Null and empty texts are never
    taken; an empty table gives no rows. A row travels as one struct, so columns may have any names.
    """
    decided = mix_sources(documents, weights, budget, repeat, seed, identity, text, source)
    decided = shared_table(decided.groupBy("doc_id", "source", "size").agg(F.sum("times").alias("total"), F.count(F.lit(1)).alias("rows")).where("total > 0").select(
        F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), F.col("size").alias("mix_size"), "total", "rows"), "decided")
    size = F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(WORD)).cast("long")
    rows = documents.select(packed(documents), F.col(f"`{identity}`").cast("long").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), size.alias("size"))
    met = rows.join(decided, F.col("doc_id").eqNullSafe(F.col("mix_id")) & F.col("source").eqNullSafe(F.col("mix_source")) & (F.col("size") == F.col("mix_size")))
    taken = met.where("rows = 1").select("record", F.col("total").alias("times"))
    if not decided.where("rows > 1").isEmpty():
        many = shared_table(met.where("rows > 1").withColumn("number", F.monotonically_increasing_id()), "repeated")
        placed = ordered_scan(many, ["doc_id", "source", "size"], [F.col("number")], [rank("place")])
        taken = taken.union(placed.select("record", F.expr("total div rows + if(place <= total % rows, 1, 0)")))
    return taken.where("times > 0").select("record", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("record.*")
