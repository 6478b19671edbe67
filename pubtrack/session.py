"""Session helpers: builder defaults, table loading, lineage cuts and size checks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side may be broadcast only when its row count is proven not to exceed this.
BROADCAST_ROWS = 200_000


def build_session(app: str = "pubtrack", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution and a UTC clock; ``conf`` overrides anything."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        # Top-k per key is cut before the shuffle up to this k.
        "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
        # Checkpoint files go when nothing refers to them any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Read one Parquet table. Timestamps compare and print in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{directory}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a local one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="pubtrack-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so that it survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` is proven to hold at most ``rows`` rows (reads no more than needed)."""
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a side of proven size; beyond it Catalyst shuffles as usual."""
    return F.broadcast(df) if is_small(df, rows) else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash the rows over all cores when the input has few partitions (some may be empty: a file
    splits only at its row groups), for steps that cost much more than reading. Inputs of many
    partitions are left where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < 4 * cores else df
