"""Exports and sinks: CSV rendering, content-addressed appends, exports with the pointer last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pubtrack.session import is_small

BOM = "﻿"


def csv_field(value: Column) -> Column:
    """Quoted field; text that a spreadsheet would run as a formula gets a leading quote mark."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    risky = F.rlike(text, F.lit(r"^[\s\p{Z}]*[=+\-@\t\r\n]"))
    guarded = F.when(risky, F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_line(columns: Sequence[Column]) -> Column:
    """One semicolon-separated line."""
    return F.concat_ws(";", *[csv_field(c) for c in columns])


def write_csv(rows: DataFrame, fields: Sequence[tuple[str, str]], order: Sequence[Column], path: str) -> None:
    """Byte order mark, header and CRLF in every part file, rows in global order over the files."""
    lines = rows.orderBy(*order).select(csv_line([F.col(c) for c, _ in fields]).alias("value"))
    header = BOM + ";".join('"' + title.replace('"', '""') + '"' for _, title in fields)
    lines.select(F.col("value").alias(header)).write.mode("errorifexists").option("header", True).option("quote", "").option(
        "quoteAll", False).option("sep", "\u0001").option("escape", "").option("lineSep", "\r\n").csv(path)


def unseen_content(candidates: DataFrame, stored: DataFrame, digest: str, order: str) -> DataFrame:
    """Candidates whose content is not stored yet, one per content: the first in order."""
    new = candidates.join(stored.select(digest).distinct(), digest, "left_anti")
    return new.groupBy(digest).agg(F.min_by(F.struct(*[c for c in candidates.columns if c != digest]), order).alias("_row")).select(
        digest, "_row.*")


def append_content(candidates: DataFrame, path: str, digest: str, order: str) -> None:
    """Idempotent append: running it again with the same content writes nothing."""
    spark = candidates.sparkSession
    stored = spark.read.parquet(path) if exists(spark, path) else candidates.limit(0)
    unseen_content(candidates, stored, digest, order).write.mode("append").parquet(path)


def prefix_of(digest: Column, digits: int = 2) -> Column:
    """Folder of a hex digest; the letter keeps folders of digits from being read as numbers."""
    return F.concat(F.lit("p"), F.left(digest, F.lit(digits)))


def stored_like(candidates: DataFrame, path: str, digest: str, digits: int = 2, few: int = 1000, schema: str | StructType | None = None) -> DataFrame:
    """The part of an archive by prefix that can hold contents of ``candidates``: only the folders of their prefixes (at most
    16 ** digits names), and of these, for a batch of ``few`` contents, only what the files' Bloom filters let through. Its
    columns are those of ``candidates`` unless ``schema`` says otherwise."""
    spark = candidates.sparkSession
    touched = [r[0] for r in candidates.select(prefix_of(F.col(digest), digits)).distinct().collect()]
    form = StructType([*candidates.schema.fields, StructField("prefix", StringType())]) if schema is None else schema
    stored = spark.read.schema(form).parquet(path).where(F.col("prefix").isin(touched))
    wanted = candidates.select(digest).distinct()
    if is_small(wanted, few):
        stored = stored.where(F.col(digest).isin([r[0] for r in wanted.collect()]))
    return stored


def append_by_prefix(candidates: DataFrame, path: str, digest: str, order: str, digits: int = 2) -> None:
    """:func:`append_content` into an archive with a folder for each prefix of the digest: what an append reads grows with
    the batch, not with the archive."""
    stored = stored_like(candidates, path, digest, digits) if exists(candidates.sparkSession, path) else candidates.limit(0)
    fresh = unseen_content(candidates, stored, digest, order).withColumn("prefix", prefix_of(F.col(digest), digits))
    by_prefix(fresh.repartition("prefix"), digest).mode("append").partitionBy("prefix").parquet(path)


def by_prefix(rows: DataFrame, digest: str):
    """Writer whose files carry a Bloom filter of the digest."""
    return rows.write.option(f"parquet.bloom.filter.enabled#{digest}", "true")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on the file system that Spark uses for it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def export(tables: dict[str, tuple[DataFrame, Sequence[str]]], root: str, generation: str, pointer: DataFrame) -> None:
    """Write allow-listed tables of an immutable generation first and the pointer last."""
    for name, (table, columns) in tables.items():
        table.select(*columns).write.mode("errorifexists").parquet(f"{root}/{generation}/{name}")
    pointer.write.mode("overwrite").json(f"{root}/pointer")

