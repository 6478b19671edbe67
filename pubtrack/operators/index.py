"""A stored trigram index: posting lists and texts in files by hash bucket, extended by generation.

``<root>/lists`` holds the records of every trigram as sorted lists, ``<root>/texts`` the texts themselves, both below
``generation=.../bucket=...``. A search opens only the buckets of its grams, joins the lists of each query's rarest
gram, and then opens only the buckets of the texts that are left. Lists of consecutive numbers are stored as
differences by Parquet's own delta encoding.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pubtrack.functions.text import trigrams
from pubtrack.operators.scan import top_per_key
from pubtrack.operators.search import PAGE, candidate_rows, rarest_gram
from pubtrack.session import cut, small_side
from pubtrack.sources.sinks import exists

#: Records of one part of a list: what one row of the index holds at most, for a gram that all records share.
PART_RECORDS = 65_536


def bucket_of(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def layout_of(spark: SparkSession, root: str) -> int | None:
    """Number of buckets of an index, None if there is none."""
    return spark.read.schema("buckets int").json(f"{root}/layout").first()["buckets"] if exists(spark, f"{root}/layout") else None


def extend_index(corpus: DataFrame, record: str, text: str, root: str, generation: str, buckets: int = 64) -> None:
    """Add the records of ``corpus`` that no generation holds yet; with none of them new, nothing is written.

    ``record`` is an integer. ``buckets`` counts when the index is new. A generation is written under its own folders and
    replaced when the call is repeated, so a lost run leaves no half of it behind. A record is in one row for each of its
    grams and about PART_RECORDS records of the generation, so no list of a popular gram is gathered whole.
    """
    spark = corpus.sparkSession
    layout = layout_of(spark, root)
    if layout is None:
        spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").json(f"{root}/layout")
    else:
        buckets = layout
    if exists(spark, f"{root}/texts"):
        known = spark.read.parquet(f"{root}/texts").where(F.col("generation") != generation).select(record)
        corpus = corpus.join(known, record, "left_anti")
    count = corpus.count()
    if not count:
        return
    parts = count // PART_RECORDS + 1
    kept = corpus.withColumn("bucket", bucket_of(F.col(record), buckets))
    store(kept.repartition("bucket"), f"{root}/texts", generation)
    held = spark.read.parquet(f"{root}/texts").where(F.col("generation") == generation)
    listed = held.select(F.col(record).alias("record"), F.explode(trigrams(F.col(text))).alias("gram")).withColumn("part", bucket_of(F.col("record"), parts))
    lists = listed.groupBy("gram", "part").agg(F.sort_array(F.collect_list("record")).alias("records"))
    lists = lists.select("gram", F.size("records").alias("n"), "records", bucket_of(F.col("gram"), buckets).alias("bucket"))
    store(lists.repartition("bucket").sortWithinPartitions("bucket", "gram"), f"{root}/lists", generation)


def store(rows: DataFrame, path: str, generation: str) -> None:
    """Write one generation by bucket."""
    options = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "partitionOverwriteMode": "dynamic"}
    rows.withColumn("generation", F.lit(generation)).write.options(**options).mode("overwrite").partitionBy("generation", "bucket").parquet(path)


def opened(spark: SparkSession, path: str, keys: DataFrame, key: str, buckets: int) -> DataFrame:
    """The files of the buckets that ``keys`` fall into; the list of buckets has at most ``buckets`` entries."""
    wanted = [r[0] for r in keys.select(bucket_of(F.col(key), buckets)).distinct().collect()]
    return spark.read.parquet(path).where(F.col("bucket").isin(wanted))


def indexed_candidates(spark: SparkSession, root: str, parsed: DataFrame, query: str, most_grams: int = 3) -> DataFrame:
    """(query, record) of the records that hold the ``most_grams`` rarest probe grams of a query. No text is read."""
    buckets = layout_of(spark, root)
    probes = parsed.where(F.col("kind") == "name").select(query, F.posexplode("grams").alias("place", "gram"))
    grams = probes.select("gram").distinct()
    lists = opened(spark, f"{root}/lists", grams, "gram", buckets).join(small_side(grams), "gram")
    sizes = lists.groupBy("gram").agg(F.sum("n").alias("size"))
    sized = probes.join(sizes, "gram", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    # A query with a gram that nobody holds has no candidate: its rarest list is empty and never met.
    chosen = top_per_key(sized, [query], [F.col("size"), F.col("place")], most_grams, name="choice")
    needed = chosen.groupBy(query).agg(F.count(F.lit(1)).alias("needed"))
    met = small_side(chosen.select(query, "gram")).join(lists, "gram").select(query, F.explode("records").alias("record"))
    both = met.groupBy(query, "record").agg(F.count(F.lit(1)).alias("held")).join(small_side(needed), query)
    return both.where(F.col("held") == F.col("needed")).select(query, "record")


def indexed_records(spark: SparkSession, root: str, parsed: DataFrame, query: str) -> DataFrame:
    """The records that hold the rarest probe gram of a query, each once. No text is read."""
    buckets = layout_of(spark, root)
    names = parsed.where(F.col("kind") == "name")
    grams = names.select(F.explode("grams").alias("gram")).distinct()
    lists = opened(spark, f"{root}/lists", grams, "gram", buckets).join(small_side(grams), "gram")
    # A query with a gram that nobody holds has no candidate: its rarest list is empty and never met.
    rarest = rarest_gram(names, query, lists.groupBy("gram").agg(F.sum("n").alias("posting_size"))).select("gram").distinct()
    return lists.join(small_side(rarest), "gram", "left_semi").select(F.explode("records").alias("record")).distinct()


def indexed_search(spark: SparkSession, root: str, record: str, text: str, parsed: DataFrame, query: str, order: Sequence[Column], page: int = PAGE,
                   skip: int = 0) -> DataFrame:
    """Pages of :func:`pubtrack.operators.search.search_names` from a stored index: query, record, the other columns of the
    corpus, position. A text that holds a rarest gram is read once and met by all queries."""
    buckets, parsed = layout_of(spark, root), cut(parsed)
    # Read twice: for the buckets of the texts, and to meet them.
    records = cut(indexed_records(spark, root, parsed, query).withColumnRenamed("record", record))
    texts = opened(spark, f"{root}/texts", records, record, buckets).drop("generation", "bucket").join(small_side(records), record)
    met = candidate_rows(texts, record, text, parsed.where(F.col("kind") == "name").select(query, "needs", "long_words"), query)
    return top_per_key(met.where("_verified").drop("_verified"), [query], order, skip + page).where(F.col("position") > skip)
