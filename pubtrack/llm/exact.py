"""Exact deduplication by an extendible-hash index on shared files.

Texts are equal when their bytes agree after lower-casing A-Z. A 64-bit key addresses them: its leading
bits select an entry of a directory, whose entries point to buckets. The directory doubles until no
bucket holds more text than its capacity. Contiguous bucket ranges, of bounded size, belong to owner
tasks; an owner chains the texts of one key and compares their bytes. The index (one row for each distinct
text) lies in shared files, from which every document reads the decision on its group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pubtrack.llm.common import LOWER, UPPER, lean, packed, shared_table, slices, texts_of

#: Most text of a bucket, deepest directory, and how much text a task combines before it passes it on.
BUCKET_BYTES, MOST_BITS, COMBINE_BYTES = 16 << 20, 20, 8 << 20


def normal(text: str) -> bytes:
    """The compared form: A-Z in lower case, all other characters unchanged."""
    return text.encode().lower()


def key_of(form: bytes) -> int:
    """Signed 64-bit key of a normalised text."""
    return xxhash.xxh64_intdigest(form) - (1 << 63)


@dataclass
class Directory:
    """``bits`` leading key bits select one of ``2 ** bits`` entries; ``bucket`` and ``owner`` by entry."""

    bits: int
    bucket: np.ndarray
    owner: np.ndarray

    @classmethod
    def grow(cls, sizes: dict[int, int], bits: int, capacity: int, owners: int) -> Directory:
        """Double the directory from depth 0 until no bucket is overfull or ``bits`` is reached.

        ``sizes`` has the bytes by leading ``bits`` bits. Only overfull buckets split; the others stay
        shared by several entries. Owners take contiguous buckets of about equal size."""
        leaf = np.zeros(1 << bits, dtype=np.int64)
        for slot, size in sizes.items():
            leaf[slot] = size
        split = [(0, 0)]
        done = []
        while split:
            depth, prefix = split.pop()
            low, high = prefix << (bits - depth), (prefix + 1) << (bits - depth)
            if depth < bits and leaf[low:high].sum() > capacity:
                split += [(depth + 1, prefix << 1 | 1), (depth + 1, prefix << 1)]
            else:
                done.append((depth, prefix, low, high))
        depth = max(d for d, *_ in done)
        bucket = np.zeros(1 << bits, dtype=np.int32)
        for number, (_, _, low, high) in enumerate(done):
            bucket[low:high] = number
        until = np.cumsum(np.bincount(bucket, weights=leaf, minlength=len(done)))
        share = np.minimum((until - 1).clip(0) * owners // max(1, int(leaf.sum())), owners - 1).astype(np.int32)
        step = 1 << (bits - depth)
        return cls(depth, bucket[::step], share[bucket[::step]])

    def entry(self, keys: np.ndarray) -> np.ndarray:
        """Directory entry of signed keys."""
        shifted = (keys.astype(np.int64) ^ np.int64(-(1 << 63))).view(np.uint64)
        return (shifted >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), dtype=np.int64)


def keyed(rows: DataFrame) -> DataFrame:
    """(doc_id, key, sha, bytes, first) of every document; ``first`` marks one of several equal rows."""
    form = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("sha", pa.string()), ("bytes", pa.int64())])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [(key_of(f), hashlib.sha256(f).hexdigest(), len(f)) for f in map(normal, batch.column("text").to_pylist())]
            columns = zip(*found) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(list(c), f.type) for c, f in zip(columns, list(form)[1:])]], schema=form)

    plain = rows.mapInArrow(lean(keys), "doc_id long, key long, sha string, bytes long").withColumn("row", F.monotonically_increasing_id())
    stored = shared_table(plain, "keys")
    # Rows with equal identity and text are told apart by their stored number; only one of them is first.
    return stored.withColumn("first", F.row_number().over(Window.partitionBy("doc_id", "key", "sha").orderBy("row")) == 1).drop("row")


def combine(rows: DataFrame, directory: Directory) -> DataFrame:
    """Texts with owner and bucket, equal ones within a task already joined (largest id, count)."""
    form = pa.schema([("owner", pa.int32()), ("bucket", pa.int32()), ("key", pa.int64()), ("form", pa.binary()), ("keep_id", pa.int64()), ("n", pa.int64())])

    def flush(held: dict[bytes, tuple]) -> pa.RecordBatch:
        keys = np.fromiter((key_of(f) for f in held), dtype=np.int64, count=len(held))
        entry = directory.entry(keys)
        ids, counts = zip(*held.values())
        return pa.RecordBatch.from_arrays([pa.array(directory.owner[entry]), pa.array(directory.bucket[entry]), pa.array(keys), pa.array(list(held), pa.binary()),
                                           pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], schema=form)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}
        size = 0
        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                f = normal(text.as_py())
                if f in held:
                    best, n = held[f]
                    held[f] = (greater(best, doc_id), n + 1)
                    continue
                held[f] = (doc_id, 1)
                size += len(f)
                if size > COMBINE_BYTES:
                    yield flush(held)
                    held, size = {}, 0
        if held:
            yield flush(held)

    return rows.mapInArrow(lean(merge), "owner int, bucket int, key long, form binary, keep_id long, n long")


def greater(a: int | None, b: int | None) -> int | None:
    """The larger id; a known one wins over null."""
    return max((x for x in (a, b) if x is not None), default=None)


def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The owner's task: fill the buckets, chain the texts of one key, compare bytes.

    Only distinct texts are held, so the memory is that of the owner's bucket range however many copies arrive."""
    form = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("sha", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
    buckets: dict[int, dict[int, list[list]]] = {}
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("bucket", "key", "keep_id", "n")]
        for bucket, key, doc_id, n, text in zip(*columns, batch.column("form")):
            chain = buckets.setdefault(bucket, {}).setdefault(key, [])
            f = text.as_py()
            for link in chain:
                if link[0] == f:
                    link[1:] = [greater(link[1], doc_id), link[2] + n]
                    break
            else:
                chain.append([f, doc_id, n])
    for bucket in sorted(buckets):
        rows = [(bucket, key, hashlib.sha256(f).hexdigest(), doc_id, n) for key, chain in buckets[bucket].items() for f, doc_id, n in chain]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), form)], schema=form)


def exact_groups(documents: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the largest identity stays (a null identity only if the group has no other); of several
    rows with equal identity and text one stays. Null text counts as empty, and empty texts are a group.
    An empty table gives no rows; other columns are not read.

    The text crosses the network once. Copies are joined inside the tasks that read them, so a text that a
    third of the rows share reaches its owner once per task and step. The join of decisions with documents
    is left to Spark's skew handling. The directory has at most ``2 ** MOST_BITS`` entries.
    """
    rows = texts_of(documents, identity, text)
    keys = keyed(rows)
    distinct = keys.groupBy("key", "sha").agg(F.first("bytes").alias("bytes"))
    total = distinct.agg(F.sum("bytes")).first()[0] or 0
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    capacity = min(BUCKET_BYTES, total // (4 * partitions) + 1)
    owners = max(partitions, total // BUCKET_BYTES + 1)
    bits = min(MOST_BITS, max(4, (total // capacity).bit_length() + 2))
    prefix = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits)
    sizes = {row["slot"]: row["bytes"] for row in distinct.groupBy(prefix.alias("slot")).agg(F.sum("bytes").alias("bytes")).collect()}
    directory = Directory.grow(sizes, bits, capacity, owners)
    owned = combine(rows, directory).repartitionById(owners, F.col("owner"))
    index = shared_table(owned.mapInArrow(lean(build), "bucket int, key long, sha string, keep_id long, group_size long"), "index")
    met = keys.join(index, ["key", "sha"])
    return met.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("first")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_distinct(documents: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that :func:`exact_groups` keeps, one for each distinct text, with all columns of ``documents``.

    Null text counts as empty, and the empty texts are one group. A null identity stays only if its group has no
    other; of rows with equal identity and text one stays. An empty table gives no rows. A row travels as one
    struct, so columns may have any names.
    """
    sha = F.sha2(F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), UPPER, LOWER), 256)
    # The join and the window have the same keys, so the documents are shuffled once.
    keys = ["sha", "number", "unnamed"]
    kept = exact_groups(documents, identity, text).where("kept").select(F.col("text_sha256").alias("sha"), *numbered(F.col("doc_id")))
    rows = documents.select(packed(documents), sha.alias("sha"), *numbered(F.col(f"`{identity}`").cast("long")))
    met = rows.join(kept, keys).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("sha")))
    return met.where("place = 1").select("record.*")


def numbered(identity: Column) -> list[Column]:
    """An identity as two join keys, so that null meets null: ``number`` and ``unnamed``."""
    return [F.coalesce(identity, F.lit(0).cast("long")).alias("number"), identity.isNull().alias("unnamed")]
