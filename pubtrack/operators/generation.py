"""Immutable generations: blocks, staging, validation, activation, rollback, recovery.

Layout on storage: ``rows/version_id=…/bucket=…`` (Parquet), ``versions`` (one small record per
generation) and ``pointer`` (one record). The pointer is replaced last; readers keep the old
generation until then.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pubtrack.functions.values import digest_parts, row_text
from pubtrack.operators.scan import ordered_scan, rank
from pubtrack.operators.validate import manifest_gate, rank_completeness
from pubtrack.session import cut
from pubtrack.sources.sinks import exists

BLOCK_ROWS = 256
BLOCK_BYTES = 512_000
BATCH_ROWS = 40


def assign_blocks(rows: DataFrame, identity: str, prefix: int = 2, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Bucket by the leading hex digits of the id and block number inside the bucket."""
    bucketed = rows.withColumn("bucket", F.left(F.col(identity), F.lit(prefix)))
    ranked = ordered_scan(bucketed, ["bucket"], [F.col(identity)], [rank("_n")])
    return ranked.withColumn("block", F.floor((F.col("_n") - 1) / block_rows)).drop("_n")


def block_sizes(blocks: DataFrame, columns: Sequence[str], most_bytes: int = BLOCK_BYTES, most_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows and bytes of every block and whether both limits hold."""
    payload = F.octet_length(F.to_json(F.struct(*columns)))
    return blocks.groupBy("bucket", "block").agg(F.count(F.lit(1)).alias("block_rows"), F.sum(payload).cast("long").alias("block_bytes")).withColumn(
        "within_limits", (F.col("block_rows") <= most_rows) & (F.col("block_bytes") <= most_bytes))


def pack_blocks(blocks: DataFrame, identity: str, columns: Sequence[str]) -> DataFrame:
    """JSON payload per block, rows in id order. A block is limited to a few hundred rows."""
    return blocks.groupBy("bucket", "block").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.col(identity).alias("_k"), F.struct(*columns).alias("_r")))),
                              lambda s: s["_r"])).alias("payload"))


def unpack_blocks(packed: DataFrame, schema: str) -> DataFrame:
    """Stored block payloads back to rows."""
    return packed.select("bucket", "block", F.explode(F.from_json("payload", f"array<struct<{schema}>>")).alias("r")).select(
        "bucket", "block", "r.*")


def block_digests(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Content digest per block."""
    parts = digest_parts(row_text([F.col(c) for c in columns]))
    named = rows.groupBy(*keys).agg(*[p.alias(f"_d{i}") for i, p in enumerate(parts)])
    return named.select(*keys, F.sha2(F.concat_ws(":", *[F.col(f"_d{i}").cast("string") for i in range(len(parts))]), 256).alias("digest"))


def compare_blocks(stored: DataFrame, offered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New, unchanged, conflicting or not offered blocks of an immutable generation."""
    met = stored.select(*keys, F.col("digest").alias("_s")).join(offered.select(*keys, F.col("digest").alias("_o")), list(keys), "full")
    return met.select(*keys, F.when(F.col("_s").isNull(), "new").when(F.col("_o").isNull(), "not_offered")
                      .when(F.col("_s") == F.col("_o"), "unchanged").otherwise("conflict").alias("outcome"))


def resume(wanted: DataFrame, staged: DataFrame, identity: str) -> tuple[DataFrame, DataFrame]:
    """Rows still to load, and staged ids outside the generation (must be none)."""
    return wanted.join(staged.select(identity), identity, "left_anti"), staged.join(wanted.select(identity), identity, "left_anti")


def micro_batches(rows: DataFrame, order: Sequence[Column], size: int = BATCH_ROWS) -> DataFrame:
    """Consecutive batches of a fixed number of rows."""
    ranked = ordered_scan(rows, [], order, [rank("_n")])
    return ranked.withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_n")


def specialty_totals(parts: Sequence[DataFrame], code: str, name: str, count: str) -> DataFrame:
    """Totals per code over several documents; the first document names the code."""
    union = None
    for i, part in enumerate(parts):
        tagged = part.select(code, name, count).withColumn("_at", F.lit(i))
        union = tagged if union is None else union.unionByName(tagged)
    return union.groupBy(code).agg(F.sum(count).alias(count), F.min_by(name, "_at").alias(name))


def generation_id(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: deterministic id of a generation from its content, and its size."""
    parts = digest_parts(row_text([F.col(c) for c in columns]))
    named = rows.agg(*[p.alias(f"_d{i}") for i, p in enumerate(parts)])
    count = F.col(f"_d{len(parts) - 1}")
    return named.select(F.sha2(F.concat_ws(":", *[F.col(f"_d{i}").cast("string") for i in range(len(parts))]), 256).alias("version_id"),
                        count.alias("row_count"))


def missing_blocks(blocks: DataFrame, search_blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks without a search block; the index of a generation is complete without any."""
    return blocks.select(*keys).distinct().join(search_blocks.select(*keys).distinct(), list(keys), "left_anti")


def active_rows(rows: DataFrame, pointer: DataFrame, versions: DataFrame) -> DataFrame:
    """Rows of the active, validated generation. The pointer is one record, so it is broadcast."""
    ready = pointer.join(versions.where("ready").select("version_id"), "version_id", "left_semi")
    return rows.join(F.broadcast(ready.limit(1)), "version_id", "left_semi")


def activation_report(rows: DataFrame, manifest: DataFrame, specialty: str, rank_column: str, identity: str) -> DataFrame:
    """Problems that forbid activation: counts that differ from the manifest, incomplete or
    repeated ranks, repeated ids. Empty when the generation may go live."""
    counts = rows.where(F.col(rank_column).isNotNull()).groupBy(specialty).agg(F.count(F.lit(1)).alias("observed"))
    totals = manifest_gate(counts, manifest, [specialty], "observed", "expected").where(~F.col("matches")).select(
        F.col(specialty).cast("string").alias("item"), F.lit("count_mismatch").alias("problem"))
    ranks = rank_completeness(rows, [specialty], rank_column).where(~F.col("complete")).select(
        F.col(specialty).cast("string").alias("item"), F.lit("rank_gap_or_repeat").alias("problem"))
    ids = rows.groupBy(identity).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(
        F.col(identity).cast("string").alias("item"), F.lit("repeated_id").alias("problem"))
    return totals.unionByName(ranks).unionByName(ids)


class GenerationStore:
    """Staging, activation, rollback and recovery of generations under one folder."""

    def __init__(self, spark: SparkSession, root: str, identity: str, columns: Sequence[str]):
        self.spark, self.root, self.identity, self.columns = spark, root.rstrip("/"), identity, list(columns)

    def _read(self, name: str) -> DataFrame | None:
        path = f"{self.root}/{name}"
        return self.spark.read.parquet(path) if exists(self.spark, path) else None

    def rows(self, version: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows").where(F.col("version_id") == version)

    def point_lookup(self, version: str, record: str) -> DataFrame:
        """One record; the derived bucket predicate prunes to one partition."""
        return self.rows(version).where((F.col("bucket") == record[:2]) & (F.col(self.identity) == record))

    def stage(self, rows: DataFrame, version: str) -> int:
        """Write the rows not staged yet, sorted by id inside their bucket; returns how many."""
        wanted = rows.select(self.identity, *self.columns).withColumn("version_id", F.lit(version)).withColumn(
            "bucket", F.left(F.col(self.identity), F.lit(2)))
        if exists(self.spark, f"{self.root}/rows/version_id={version}"):
            todo, foreign = resume(wanted, self.rows(version), self.identity)
            if foreign.limit(1).count():
                raise ValueError("staged rows outside the generation")
            wanted = todo
        wanted = cut(wanted)
        # Range partitions by id: many tasks per bucket when it is large, few files when small.
        (wanted.repartitionByRange("bucket", self.identity).sortWithinPartitions(self.identity)
         .write.mode("append").partitionBy("version_id", "bucket").parquet(f"{self.root}/rows"))
        return wanted.count()

    def digest(self, version: str) -> str:
        return generation_id(self.rows(version), [self.identity, *self.columns]).first()["version_id"]

    def validate(self, version: str, manifest: DataFrame, specialty: str, rank_column: str) -> str:
        """Digest of the validated staged set; when a gate fails, all problems are written to ``problems``
        of the store and the error says how many there are and where."""
        problems = activation_report(self.rows(version), manifest, specialty, rank_column, self.identity)
        place = f"{self.root}/problems/version_id={version}"
        problems.write.mode("overwrite").parquet(place)
        found = self.spark.read.schema(problems.schema).parquet(place).groupBy("problem").count().orderBy("problem").collect()
        if found:
            raise ValueError(f"generation not accepted, {place} lists: {[(r['problem'], r['count']) for r in found]}")
        return self.digest(version)

    def activate(self, version: str, validated_digest: str) -> None:
        """Flip the pointer when nothing was staged since validation."""
        if self.digest(version) != validated_digest:
            raise ValueError("staged rows changed after validation")
        if not self.is_ready(version):
            self.spark.createDataFrame([(version, validated_digest)], "version_id string, digest string").write.mode("append").parquet(
                f"{self.root}/versions")
        self._point(version)

    def _point(self, version: str) -> None:
        number = (self.pointer_number() or 0) + 1
        self.spark.createDataFrame([(number, version)], "number long, version_id string").coalesce(1).write.mode("append").parquet(
            f"{self.root}/pointer")

    def pointer_number(self) -> int | None:
        table = self._read("pointer")
        return None if table is None else table.agg(F.max("number")).first()[0]

    def active(self) -> str | None:
        """Active generation: the pointer record with the highest number."""
        table = self._read("pointer")
        return None if table is None else table.agg(F.max_by("version_id", "number")).first()[0]

    def is_ready(self, version: str) -> bool:
        table = self._read("versions")
        return table is not None and table.where(F.col("version_id") == version).limit(1).count() > 0

    def rollback(self, version: str) -> None:
        """Point back to a generation that was validated before."""
        if not self.is_ready(version):
            raise ValueError("only a validated generation can become active")
        self._point(version)

    def recover(self, version: str) -> None:
        """Delete the staged rows of a generation that never became ready."""
        if self.is_ready(version):
            raise ValueError("a validated generation is immutable")
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.root}/rows/version_id={version}")
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
