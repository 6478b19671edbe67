"""Substring deduplication by difference-cover anchors.

A word is removed when it lies in a window of ``length`` consecutive words that also starts in a document
with a smaller identity. Windows are found from anchors: runs of ``anchor`` words that start at positions
whose remainder modulo ``PERIOD`` is in a difference cover. Every remainder is a difference of two members of
the cover, so for any two places where a long match starts there is a shift below ``PERIOD`` that brings both to
a member: each long match contains an anchor at the same offset in both documents. Only anchors that two documents
share are extended to the windows around them, and only those windows are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pubtrack.llm.common import shared_table, slices, texts_of
from pubtrack.llm.shingles import mixed, words_of

#: A perfect difference set: every residue other than 0 is the difference of exactly one pair.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: Bytes of text that a task hashes and combines in one step.
STEP_BYTES = 4 << 20

HASHED = pa.schema([("hash", pa.int64()), ("doc_id", pa.int64()), ("id", pa.int64()), ("at", pa.int32()), ("known", pa.bool_())])
HASHED_SQL = "hash long, doc_id long, id long, at int, known boolean"


def text_id(text: bytes) -> int:
    """Signed 64 bits that tell apart texts of one identity."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def steps(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[list, ...]]:
    """Rows of ``columns`` as lists, in steps of about STEP_BYTES of the last column; the text comes as bytes."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in columns]):
            row = (*row[:-1], row[-1].encode())
            held.append(row)
            size += len(row[-1])
            if size > STEP_BYTES:
                yield tuple(map(list, zip(*held)))
                held, size = [], 0
    if held:
        yield tuple(map(list, zip(*held)))


def combined(hashes: np.ndarray, docs: np.ndarray, ids: np.ndarray, places: np.ndarray, judge_all: bool) -> pa.RecordBatch:
    """Occurrences of one step, with those whose answer the step itself knows marked ``known``.

    For one hash only the document of least identity must still meet other steps. The other documents have a
    smaller one beside them. Their hash is replaced by a hash of the place, so that they spread over all tasks. With
    ``judge_all`` (is it shared at all?) the answer of the least document is known, too, when there is another.
    """
    order = np.lexsort((docs, hashes))
    hashes, docs, ids, places = hashes[order], docs[order], ids[order], places[order]
    new = np.r_[True, hashes[1:] != hashes[:-1]] if len(hashes) else np.empty(0, dtype=bool)
    group = np.cumsum(new) - 1
    least = docs[np.flatnonzero(new)][group] if len(hashes) else docs
    other = docs > least
    known = other.copy()
    if judge_all and len(hashes):
        known |= np.bincount(group, weights=other)[group] > 0
    spread = mixed(docs.view(np.uint64) * np.uint64(PERIOD) + places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return pa.RecordBatch.from_arrays([pa.array(np.where(other, spread, hashes).view(np.int64)), pa.array(docs), pa.array(ids), pa.array(places.astype(np.int32)),
                                       pa.array(known)], schema=HASHED)


def anchors(rows: DataFrame, anchor: int) -> DataFrame:
    """Anchor hashes of every document, reduced to one document per hash and step."""
    def find(batches):
        for doc_ids, texts in steps(batches, "doc_id", "text"):
            words = words_of(texts, lower=False)
            hashes, inside = words.windows(anchor)
            start = np.repeat(words.first[:-1], np.diff(words.first))[:len(hashes)]
            owner = np.repeat(np.arange(len(texts)), np.diff(words.first))[:len(hashes)]
            place = np.arange(len(hashes)) - start
            take = np.flatnonzero(inside & IN_COVER[place % PERIOD])
            ids = np.array([text_id(t) for t in texts], dtype=np.int64)
            yield combined(hashes[take], np.array(doc_ids, dtype=np.int64)[owner[take]], ids[owner[take]], place[take], True)

    return rows.mapInArrow(find, HASHED_SQL)


def windows(rows: DataFrame, length: int) -> DataFrame:
    """Hashes of the windows around the shared anchors (``places``) of every document of ``rows``."""
    def extend(batches):
        for doc_ids, ids, places, texts in steps(batches, "doc_id", "id", "places", "text"):
            words = words_of(texts, lower=False)
            hashes, inside = words.windows(length)
            if not len(hashes):
                continue
            wanted = np.zeros(len(words.hashes) + 1, dtype=np.int32)
            for at, found in zip(words.first, places):
                found = np.unique(np.array(found, dtype=np.int64))
                np.add.at(wanted, at + np.maximum(found - PERIOD + 1, 0), 1)
                np.add.at(wanted, at + found + 1, -1)
            owner = np.repeat(np.arange(len(texts)), np.diff(words.first))[:len(hashes)]
            take = np.flatnonzero((np.cumsum(wanted)[:len(hashes)] > 0) & inside)
            yield combined(hashes[take], np.array(doc_ids, dtype=np.int64)[owner[take]], np.array(ids, dtype=np.int64)[owner[take]], take - words.first[owner[take]], False)

    return rows.mapInArrow(extend, HASHED_SQL)


def kept_text(words: list[bytes], starts: list[int] | None, length: int) -> tuple[int, bytes]:
    """Number of removed words, and the others joined by one space."""
    if not starts:
        return 0, b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int32)
    at = np.unique(np.array(starts, dtype=np.int64))
    edge[at] += 1
    np.add.at(edge, at + length, -1)
    covered = np.cumsum(edge)[:-1] > 0
    return int(covered.sum()), b" ".join([w for w, gone in zip(words, covered) if not gone])


def identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the text's own 64 bits."""
    for batch in slices(batches, "text"):
        ids = pa.array([text_id(t.encode()) for t in batch.column("text").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, batch.column("text")], names=["doc_id", "id", "text"])


def cut_out(length: int):
    """Arrow function that removes the windows at ``starts``."""
    form = pa.schema([("doc_id", pa.int64()), ("id", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])

    def cut(batches):
        for doc_ids, ids, starts, texts in steps(batches, "doc_id", "id", "starts", "text"):
            done = [kept_text(t.split(), at, length) for at, t in zip(starts, texts)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids), pa.array(ids), pa.array([n for n, _ in done], pa.int64()),
                                              pa.array([t.decode() for _, t in done])], schema=form)

    return cut, "doc_id long, id long, n_removed long, text string"


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Identity, number of words and digest of a document that loses nothing."""
    for batch in slices(batches, "text"):
        texts = [t.encode() for t in batch.column("text").to_pylist()]
        words = [t.split() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([text_id(t) for t in texts], pa.int64()), pa.array([len(w) for w in words], pa.int64()),
                                          pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words], pa.string())],
                                         names=["doc_id", "id", "n_words", "whole_sha256"])


def shortened(documents: DataFrame, identity: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """The documents that lose words, once for each identity and text: doc_id, id, n_removed, text.

    What is shuffled: one row per anchor (6 of 31 positions) and step; the text once, towards the places found
    in it; one row per window of passages that are shared; the text of documents that lose words. A passage that
    a third of all documents share is reduced to one document per step before the shuffle.
    """
    named = texts_of(documents, identity, text).where("doc_id IS NOT NULL")
    by_hash = Window.partitionBy("hash")
    shared = F.col("known") | (F.min("doc_id").over(by_hash) < F.max("doc_id").over(by_hash)) | F.max("known").over(by_hash)
    judged = anchors(named, length - PERIOD + 1).withColumn("shared", shared).where("shared")
    places = shared_table(judged.groupBy("doc_id", "id").agg(F.collect_set("at").alias("places")), "places")
    suspects = named.mapInArrow(identified, "doc_id long, id long, text string").join(places, ["doc_id", "id"])
    suspects = shared_table(suspects.select("doc_id", "id", "places", "text"), "suspects")
    gone = F.col("known") | (F.min("doc_id").over(by_hash) < F.col("doc_id"))
    repeats = windows(suspects, length).withColumn("gone", gone).where("gone")
    starts = repeats.groupBy("doc_id", "id").agg(F.collect_set("at").alias("starts"))
    losers = suspects.select("doc_id", "id", "text").join(starts, ["doc_id", "id"]).select("doc_id", "id", "starts", "text")
    return losers.mapInArrow(*cut_out(length)).dropDuplicates(["doc_id", "id"])


def remove_repeats(documents: DataFrame, identity: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """One row per document row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    Null text has no words. A row without identity keeps all its words and takes none from others; rows with
    equal identity do not take words from each other, and equal rows give equal results. ``length`` is more than
    ``PERIOD``. An empty table gives no rows; other columns are not read. :func:`shortened` gives the texts.
    """
    lost = shortened(documents, identity, text, length).select("doc_id", "id", "n_removed", F.sha2("text", 256).alias("kept"))
    stats = texts_of(documents, identity, text).mapInArrow(whole, "doc_id long, id long, n_words long, whole_sha256 string")
    return stats.join(lost, ["doc_id", "id"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "whole_sha256").alias("kept_sha256"))
