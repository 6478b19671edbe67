"""Readers for state, manifests, registries, stored originals and run logs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pubtrack.functions.values import clean_number, clean_stamp, clean_text, closed
from pubtrack.operators.operations import RUN_STATUSES

ROW = """id: string, center_code: string, center: string, municipality: string, function_code: string, function: string,
 body_code: string, body: string, cupo: string, itinerant: string, jornada: string, workload: string, hours: int, quantity: int,
 language: string, page: int, row_number: int"""
STATE = f"""documents array<struct<id: string, sha256: string, title: string, process_id: string, published_at: string, status: string,
 evidence_status: string, row_count: int, places: int, retrieved_at: string, source_url: string, rows: array<struct<{ROW}>>>>,
 catalog struct<notices: array<struct<id: string, url: string, title: string, date: string, kind: string, status: string, document_id: string,
 pdf_urls: array<string>>>, checks: array<struct<id: string, url: string, checked_at: string, status: string, success: boolean, error_code: string>>>"""


def read_state(spark: SparkSession, path: str, multi_line: bool = True) -> dict[str, DataFrame]:
    """Publications, their rows, notices and checks of stored state documents, one per file or, without
    ``multi_line``, one per line. A document that does not fit the declared schema fails the read."""
    state = spark.read.schema(STATE).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)
    documents = state.select(F.explode("documents").alias("d")).select("d.*")
    return {
        "publications": documents.drop("rows"),
        "rows": documents.select(F.col("id").alias("document_id"), F.explode("rows").alias("r")).select("document_id", "r.*"),
        "notices": state.select(F.explode("catalog.notices").alias("n")).select("n.*"),
        "checks": state.select(F.explode("catalog.checks").alias("c")).select("c.*"),
    }


def state_problems(state: Mapping[str, DataFrame]) -> DataFrame:
    """Shape rules of the state: ids present, counts whole and not negative, status known."""
    publications = state["publications"].select("id", F.array_compact(F.array(
        F.when(F.col("id").isNull() | ~F.rlike("id", F.lit("^[0-9a-f]{64}$")), F.lit("document_id")),
        F.when(F.col("row_count").isNull() | (F.col("row_count") < 0), F.lit("row_count")),
        F.when(F.col("places").isNull() | (F.col("places") < 0), F.lit("places")),
        F.when(clean_stamp(F.col("published_at")).isNull(), F.lit("published_at")))).alias("v"))
    rows = state["rows"].select("id", F.array_compact(F.array(
        F.when(F.col("id").isNull(), F.lit("row_id")), F.when(F.col("quantity").isNull() | (F.col("quantity") < 0), F.lit("quantity")))).alias("v"))
    return publications.unionByName(rows).select("id", F.explode("v").alias("problem"))


AMENDMENTS = "array<struct<content_id: string, sha256: string, kind: string>>"
MANIFEST = (f"content_id string, kind string, sha256 string, amendments {AMENDMENTS}, documents array<struct<content_id: string, kind: string, "
            f"sha256: string, incorporated: boolean, observation_only: boolean, amendments: {AMENDMENTS}>>, "
            f"references array<struct<content_id: string, sha256: string, kind: string, incorporated: boolean>>, observations {AMENDMENTS}")


def flatten_manifest(manifest: DataFrame) -> DataFrame:
    """Every entry of a nested manifest: documents, their amendments, references, observations. Amendments
    inherit the ``incorporated`` and ``observation_only`` flags of their parent."""
    def flat(rows: DataFrame, origin: str, incorporated: Column, observed: Column) -> DataFrame:
        return rows.select("content_id", "sha256", "kind", F.lit(origin).alias("origin"),
                           F.coalesce(incorporated, F.lit(False)).alias("incorporated"), F.coalesce(observed, F.lit(False)).alias("observation_only"))

    documents = manifest.select(F.explode("documents").alias("d")).select("d.*")
    parts = [
        flat(documents, "document", F.col("incorporated"), F.col("observation_only")),
        flat(documents.select(F.explode("amendments").alias("a"), "incorporated", "observation_only").select("a.*", "incorporated", "observation_only"),
             "amendment", F.col("incorporated"), F.col("observation_only")),
        flat(manifest.select(F.explode("amendments").alias("a")).select("a.*"), "amendment", F.lit(True), F.lit(False)),
        flat(manifest.select(F.explode("references").alias("r")).select("r.*"), "reference", F.col("incorporated"), F.lit(False)),
        flat(manifest.select(F.explode("observations").alias("o")).select("o.*"), "observation", F.lit(False), F.lit(True)),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def required_documents(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Baseline, amendments, documents and their amendments; and ids listed more than once."""
    baseline = manifest.where(F.col("content_id").isNotNull()).select("content_id", "sha256", F.coalesce("kind", F.lit("baseline")).alias("kind"))
    entries = flatten_manifest(manifest).where(F.col("origin").isin("document", "amendment") & ~F.col("observation_only")).select("content_id", "sha256", "kind")
    required = baseline.unionByName(entries)
    return required, required.groupBy("content_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


#: Tasks that read stored originals; they share the folders, 256 in all.
READ_TASKS = 64


def uri_of(path: str) -> str:
    """The path with its scheme; one without is local."""
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def store_originals(contents: DataFrame, path: str, suffix: str = "pdf") -> None:
    """Write each row (sha256, content) as a file named by its hash, in folders by the hash's first two digits. Tasks write
    their rows side by side through Hadoop's file system; a repeated task writes the same files again."""
    uri = uri_of(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        target, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for name, content in zip(batch.column("sha256").to_pylist(), batch.column("content").to_pylist()):
                folder = f"{root}/{name[:2]}"
                target.create_dir(folder, recursive=True)
                with target.open_output_stream(f"{folder}/{name}.{suffix}") as out:
                    out.write(content)
            yield batch.select(["sha256"])

    contents.select("sha256", "content").mapInArrow(write, "sha256 string").write.format("noop").mode("overwrite").save()


def stored_originals(spark: SparkSession, path: str, suffix: str = "pdf") -> DataFrame:
    """Stored files whose name is the hash of their bytes; ``verified`` is false for altered ones. Tasks list the folders
    and read the files through Hadoop's file system as :func:`store_originals` writes them, so the driver holds no list of
    files and a file is hashed piece by piece. Names that start with a dot or an underscore are left out, folders too."""
    form = pa.schema([("sha256", pa.string()), ("actual_sha256", pa.string()), ("bytes", pa.int64())])
    uri, ending = uri_of(path), f".{suffix}"

    def folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The top folder and the folders in it; only the files of the top folder itself belong to it."""
        from pyarrow import fs

        source, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            if batch.num_rows:
                found = [i.path for i in source.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory and i.base_name[0] not in "._"]
                yield pa.RecordBatch.from_arrays([pa.array([root, *found]), pa.array([False] + [True] * len(found))], names=["folder", "deep"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        source, _ = fs.FileSystem.from_uri(uri)

        def files(folder: str, deep: bool) -> Iterator:
            for i in source.get_file_info(fs.FileSelector(folder)):
                if i.base_name[0] in "._":
                    continue
                if i.type == fs.FileType.Directory:
                    if deep:
                        yield from files(i.path, True)
                elif i.base_name.endswith(ending):
                    yield i

        def checked(info) -> tuple[str, str, int]:
            digest, size = hashlib.sha256(), 0
            with source.open_input_stream(info.path) as held:
                while piece := held.read(1 << 20):
                    digest.update(piece)
                    size += len(piece)
            return info.base_name[:-len(ending)], digest.hexdigest(), size

        for batch in batches:
            for folder, deep in zip(batch.column("folder").to_pylist(), batch.column("deep").to_pylist()):
                found = files(folder, deep)
                while some := [checked(i) for i in islice(found, 1000)]:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*some), form)], schema=form)

    listed = spark.range(0, 1, 1, 1).mapInArrow(folders, "folder string, deep boolean").repartition(READ_TASKS)
    return listed.mapInArrow(read, "sha256 string, actual_sha256 string, bytes long").select(
        "sha256", "actual_sha256", "bytes", (F.col("sha256") == F.col("actual_sha256")).alias("verified"))


# Defaults of registry sources.
DEFAULT_PRIORITY = 50
DEFAULT_QUEUE = "recent"


def registry_sources(raw: DataFrame) -> DataFrame:
    """Registry with defaults for priority, queue and descriptive fields."""
    filled = raw.withColumn("priority", F.coalesce("priority", F.lit(DEFAULT_PRIORITY))).withColumn("queue", F.coalesce("queue", F.lit(DEFAULT_QUEUE)))
    for column in ("family", "body"):
        if column in raw.columns:
            filled = filled.withColumn(column, F.coalesce(F.col(column), F.lit("unspecified")))
    return filled


RUN = "run_id string, code_sha string, trigger string, request_id string, started_at string, ended_at string, scheduled_at string, elapsed_seconds string, status string, phases map<string, struct<started_at: string, ended_at: string, elapsed_seconds: string, status: string, exit_code: string>>"
# What may start a run.
TRIGGERS = ["schedule", "workflow_dispatch", "worker_cron", "push", "local"]


def read_runs(payloads: DataFrame, payload: str) -> tuple[DataFrame, DataFrame]:
    """Runs and their phases from JSON texts; every malformed field becomes null or its default."""
    raw = payloads.select(F.from_json(F.col(payload), RUN, {"mode": "PERMISSIVE"}).alias("r")).where("r IS NOT NULL").select("r.*")
    runs = raw.select(
        clean_text(F.col("run_id"), "[a-zA-Z0-9:_-]{1,100}").alias("run_id"), clean_text(F.col("code_sha"), "[a-fA-F0-9]{7,64}").alias("code_sha"),
        closed(F.col("trigger"), TRIGGERS, "unknown").alias("trigger"), clean_text(F.col("request_id"), "[a-f0-9]{32}").alias("request_id"),
        *[clean_stamp(F.col(c)).alias(c) for c in ("started_at", "ended_at", "scheduled_at")],
        clean_number(F.col("elapsed_seconds")).alias("elapsed_seconds"), closed(F.col("status"), RUN_STATUSES, "failed").alias("status"))
    code = F.col("p.exit_code").try_cast("int")
    phases = raw.select(clean_text(F.col("run_id"), "[a-zA-Z0-9:_-]{1,100}").alias("run_id"), F.explode("phases").alias("phase", "p")).select(
        "run_id", "phase", clean_stamp(F.col("p.started_at")).alias("started_at"), clean_stamp(F.col("p.ended_at")).alias("ended_at"),
        clean_number(F.col("p.elapsed_seconds")).alias("elapsed_seconds"), closed(F.col("p.status"), RUN_STATUSES, "failed").alias("status"),
        F.when(code.between(-255, 255), code).alias("exit_code"))
    return runs, phases
