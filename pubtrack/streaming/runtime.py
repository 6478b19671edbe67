"""Stream sources and sinks on shared storage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pubtrack.session import checkpoint_dir


def table_stream(spark: SparkSession, directory: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """Stream over the Parquet files of one table, which is a file or a folder of files. Wall-clock stamps become UTC
    instants, as watermarks need instants."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    # A stream takes a single file only as a pattern; this one matches the table itself and nothing else.
    table = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{directory}/{name}.parque[t]")
    for item in schema.fields:
        if isinstance(item.dataType, T.TimestampNTZType):
            table = table.withColumn(item.name, F.col(item.name).cast("timestamp"))
    return table


def run_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"


#: Store of operators with timers and state variables of their own.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def drain(stream: DataFrame, mode: str = "append", conf: dict[str, str] | None = None) -> DataFrame:
    """Process everything available into Parquet on shared storage and read the result. ``conf`` holds for this stream only:
    it is read when the stream starts and then set back."""
    spark, folder = stream.sparkSession, run_folder(stream.sparkSession)
    before = {key: spark.conf.get(key, None) for key in conf or {}}
    try:
        for key, value in (conf or {}).items():
            spark.conf.set(key, value)
        query = (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out")
                 .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def drain_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None]) -> None:
    """Process everything available batch by batch."""
    folder = run_folder(stream.sparkSession)
    query = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
