"""Globally shuffled shards by a two-pass external shuffle, in DataFrame functions only.

The first pass scatters the rows by a seeded hash into buckets that fit in memory. The second one shuffles every
bucket by Fisher-Yates with seeded draws; the buckets one after the other are a random order of the whole table,
which is cut into shards of equal counts and written.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pubtrack.llm.common import shared_table
from pubtrack.session import small_side

#: Rows and bytes that a bucket has on average; a bucket with OVERFULL times as many rows is dealt out further.
BUCKET_ROWS, BUCKET_BYTES, OVERFULL = 1024, 4 << 20, 4
#: Bytes of text that a task of the second pass shuffles, bucket after bucket.
TASK_BYTES = 32 << 20


def drawn(*parts: Column) -> Column:
    """A number below 2 ** 48 drawn by a digest of ``parts``; null parts are left out."""
    return F.conv(F.left(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), F.lit(12)), 16, 10).cast("long")


def fisher_yates(order: Column, *seeds: Column) -> Column:
    """``order`` shuffled: element i goes to a drawn place j <= i, and the one there moves to the end."""
    def step(held, i):
        j = F.pmod(drawn(*seeds, i), i + 1).cast("int")
        moved = F.when(j < i, F.array(F.get(held, j))).otherwise(F.array().cast("array<int>"))
        return F.concat(F.slice(held, F.lit(1), j), F.array(F.get(order, i)), F.slice(held, j + 2, F.greatest(i - j - 1, F.lit(0))), moved)

    return F.aggregate(F.sequence(F.lit(0), F.size(order) - 1), F.array().cast("array<int>"), step)


def starts_of(counts: DataFrame, buckets: int) -> DataFrame:
    """``counts`` (bucket, sub, n) with the number of rows before each bucket. Sums are carried over bands of buckets,
    so that no task orders more than about the square root of all buckets."""
    band = F.floor(F.col("bucket") / (isqrt(buckets) + 1))
    banded = counts.withColumn("band", band)
    sums = banded.groupBy("band").agg(F.sum("n").alias("rows"))
    earlier = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("band", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("band").orderBy("bucket", "sub").rowsBetween(Window.unboundedPreceding, -1)
    return banded.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, "band").select(
        "bucket", "sub", (F.col("base") + F.col("inside")).alias("start"))


def write_shards(documents: DataFrame, path: str, shards: int = 40, seed: str = "shards", identity: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``documents`` in random order as Parquet under ``path`` (one folder for each shard) and read it back:
    shard, slot, record (the whole row as a struct, so no column can clash).

    Shards are numbered from 0, slots from 0 without gaps in each; the shards' counts are at most one apart. The
    order depends on seed, identities and texts only, up to rows whose identity and text both repeat. Null texts and
    identities are rows like any other; an empty table gives no rows.

    A bucket is what one task holds at a time: about BUCKET_ROWS rows or BUCKET_BYTES of text. Rows of one identity
    fall into one bucket; where that makes it overfull, the table is stored with row numbers and the bucket dealt
    out by them. The texts cross the network once.
    """
    spark = documents.sparkSession
    record = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    rows = documents.select(F.col(f"`{identity}`").cast("long").alias("doc_id"), F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("bytes"), record.alias("record"))
    total, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    buckets = max(1, -(-total // BUCKET_ROWS), -(-(size + 16 * total) // BUCKET_BYTES))
    rows = rows.withColumn("bucket", F.pmod(drawn(F.lit(seed), F.col("doc_id")), F.lit(buckets))).withColumn("sub", F.lit(0))
    counts = shared_table(rows.groupBy("bucket", "sub").agg(F.count(F.lit(1)).alias("n")), "counts")
    overfull = counts.where(F.col("n") > OVERFULL * BUCKET_ROWS)
    if not overfull.isEmpty():
        splits = small_side(overfull.select("bucket", F.ceil(F.col("n") / BUCKET_ROWS).alias("splits")))
        stored = shared_table(rows.drop("sub").withColumn("row", F.monotonically_increasing_id()), "rows")
        rows = stored.join(splits, "bucket", "left").withColumn("sub", F.pmod(F.xxhash64("row"), F.coalesce("splits", F.lit(1))).cast("int"))
        counts = shared_table(rows.groupBy("bucket", "sub").agg(F.count(F.lit(1)).alias("n")), "counts")

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES + 1)
    task = F.floor(F.col("bucket") * tasks / buckets).cast("int")
    # The start of a bucket travels with its rows as one more row without a record.
    marks = starts_of(counts, buckets).select("bucket", "sub", "start", F.lit(None).cast(rows.schema["record"].dataType).alias("record"))
    both = rows.select("bucket", "sub", F.lit(None).cast("long").alias("start"), "record").unionByName(marks)
    dealt = both.withColumn("task", task).repartitionById(tasks, F.col("task"))
    held = dealt.groupBy("task", "bucket", "sub").agg(F.max("start").alias("start"), F.collect_list("record").alias("records"))
    keys = F.sort_array(F.transform("records", lambda r, i: F.struct(r[identity].cast("long").alias("a"), r[text].cast("string").alias("b"), i.alias("i"))))
    order = F.transform(keys, lambda k: k["i"])
    held = held.withColumn("order", order).withColumn("order", fisher_yates(F.col("order"), F.lit(seed), F.col("bucket"), F.col("sub")))
    one = held.select("start", F.posexplode(F.transform("order", lambda i: F.get("records", i))).alias("at", "record"))
    position = F.col("start") + F.col("at")
    placed = one.withColumn("shard", F.expr(f"int((start + at) * {shards} div {max(total, 1)})"))
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    placed.select("shard", (position - first).alias("slot"), "record").write.partitionBy("shard").parquet(path)
    return spark.read.schema(placed.select("shard", F.lit(0).cast("long").alias("slot"), "record").schema).parquet(path)
