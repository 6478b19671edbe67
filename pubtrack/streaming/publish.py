"""Incremental publication loop: only unseen content is processed, every decision is logged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubtrack.sources.sinks import by_prefix, exists, prefix_of, stored_like
from pubtrack.streaming.runtime import drain_batches


class PublishLoop:
    """Accepts new content once, keeps a registry of rejected content and logs checks.

    Each micro-batch writes into folders of its own, replaced when the batch is retried, so a lost
    executor or a restart does not publish anything twice. Accepted content lies in folders by the prefix of its
    digest, and a batch reads only those that it touches.
    """

    def __init__(self, root: str, identity: str, content: str, order: str, valid: Column):
        self.root, self.identity, self.content, self.order, self.valid = root, identity, content, order, valid

    def handle(self, batch: DataFrame, number: int) -> None:
        """One micro-batch: hash, drop known content, validate, append, log."""
        hashed = batch.withColumn("sha256", F.sha2(self.content, 256))
        path = f"{self.root}/accepted"
        known = hashed.select("sha256").limit(0)
        if exists(batch.sparkSession, path):
            # Batches from this one on belong to a failed attempt and do not count.
            known = stored_like(hashed, path, "sha256", schema="sha256 string, prefix string, batch int").where(F.col("batch") < number).select("sha256")
        first = hashed.groupBy("sha256").agg(F.min(self.order).alias(self.order))
        fresh = first.join(known, "sha256", "left_anti").select("sha256", self.order)
        new = hashed.join(fresh, ["sha256", self.order], "left_semi").withColumn("_valid", F.coalesce(self.valid, F.lit(False)))
        accepted = new.where("_valid").drop("_valid").withColumn("prefix", prefix_of(F.col("sha256"))).withColumn("batch", F.lit(number))
        by_prefix(accepted.repartition("prefix"), "sha256").option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("prefix", "batch").parquet(path)
        self._write(new.where("NOT _valid").select("sha256", self.identity), "rejected", number)
        checks = hashed.join(new.select("sha256", self.order, "_valid"), ["sha256", self.order], "left")
        status = F.when(F.col("_valid").isNull(), "already_known").when(F.col("_valid"), "read").otherwise("failed")
        self._write(checks.select(self.identity, "sha256", status.alias("status")), "checks", number)

    def _write(self, rows: DataFrame, name: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={number}")

    def run(self, stream: DataFrame) -> None:
        drain_batches(stream, self.handle)

    def rejected(self, frame: DataFrame) -> DataFrame:
        """Rejected content that was not accepted later."""
        spark = frame.sparkSession
        return spark.read.parquet(f"{self.root}/rejected").join(
            spark.read.parquet(f"{self.root}/accepted").select("sha256"), "sha256", "left_anti")
