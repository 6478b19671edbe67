"""Spelling variants by PartEnum signatures.

A word is the set of its letters numbered by occurrence (its letter multiset as a binary vector). One inserted,
deleted or replaced letter changes at most DISTANCE members of the set. The possible members are dealt into PARTS
parts by hash, so two such sets agree on at least PARTS - DISTANCE parts: a word has one signature for every choice
of that many parts, and near words share one. A signature also names what else near words must share: the shorter
one's length, and its first or its second half. Equal signatures are joined and every pair is verified.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubtrack.llm.common import shared_table

#: Fixed value: the letters of a word (after A-Z became lower case).
RUN = re.compile("[a-zÀ-ÿ]+")
OTHER = re.compile("[^a-zÀ-ÿ]")
DISTANCE, PARTS = 2, 4
#: Characters that are searched for words at a time, and different words that a task holds before it passes their counts on.
PIECE, HELD = 1 << 20, 200_000


def pieces(text: str) -> Iterator[str]:
    """``text`` in pieces of about PIECE characters, cut between words."""
    at = 0
    while len(text) - at > PIECE:
        cut = OTHER.search(text, at + PIECE)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def damaged(run: str, checksum: int, every: int) -> str:
    """``run`` without the letter that ``checksum`` chooses, for one of ``every`` checksums."""
    if not every or checksum % every:
        return run
    place = checksum % len(run)
    return run[:place] + run[place + 1:]


def word_counts(least_length: int, every: int):
    """Arrow function: (word, n) of the texts of a task, summed as far as its memory allows. A letter is dropped from
    the runs whose checksum with the document's identity ``every`` divides (0: none)."""
    form = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = defaultdict(int)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                seed = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for piece in pieces((text.as_py() or "").encode().lower().decode()):
                    for word, n in Counter(RUN.findall(piece)).items():
                        word = damaged(word, crc32(word.encode(), seed), every)
                        if len(word) >= least_length:
                            total[word] += n
                    if len(total) > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], schema=form)
                        total = defaultdict(int)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], schema=form)

    return run, "word string, n long"


def parts_of(word: str, cache: dict[tuple[str, int], int]) -> list[int]:
    """One hash for each part of the word's set, independent of the order of its letters."""
    parts, seen = [0] * PARTS, defaultdict(int)
    for letter in word:
        seen[letter] += 1
        member = (letter, seen[letter])
        h = cache.get(member)
        if h is None:
            h = cache[member] = xxhash.xxh64_intdigest(f"{letter}{seen[letter]}")
        parts[h % PARTS] ^= h
    return parts


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: (signature, longer, word, n); ``longer`` marks those that only a shorter word's may meet."""
    form = pa.schema([("signature", pa.int64()), ("longer", pa.bool_()), ("word", pa.string()), ("n", pa.int64())])
    cache: dict[tuple[str, int], int] = {}
    chosen = list(combinations(range(PARTS), PARTS - DISTANCE))
    for batch in batches:
        rows = []
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
            parts = parts_of(word, cache)
            for longer in (False, True):
                length = len(word) - longer
                half = length // 2
                for side, shared in (("a", word[:half]), ("b", word[len(word) - (length - half):])):
                    for some in chosen:
                        key = xxhash.xxh64_intdigest(f"{length}{side}{shared} {some} {[parts[i] for i in some]}")
                        rows.append((key - (1 << 63), longer, word, n))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), form)], schema=form)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): every ordered pair of ``words`` (word, n) that differ by one letter inserted, deleted
    or replaced. Words are distinct; signatures may meet by chance, the distance decides."""
    signed = shared_table(words.mapInArrow(signatures, "signature long, longer boolean, word string, n long"), "signatures")
    one = signed.where("NOT longer").select("signature", "word", "n")
    two = signed.select("signature", "longer", F.col("word").alias("other"), F.col("n").alias("other_n"))
    met = one.join(two, "signature").where((F.col("longer") | (F.col("word") < F.col("other"))) & (F.levenshtein("word", "other", 1) == 1))
    pairs = met.select("word", "n", "other", "other_n").distinct()
    pairs = shared_table(pairs, "pairs")
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the end of the chain of forms, by doubling of pointers. A form is at
    least twice as frequent as its word, so chains are short and have no circles."""
    links = shared_table(forms.select("word", F.col("form").alias("root")), "chains")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        jumped = shared_table(jumped, "chains")
        links = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return links


def spelling_groups(documents: DataFrame, identity: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3, factor: int = 2,
                    damage_every: int = 0) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are the maximal runs of letters (A-Z in lower case) of at least ``least_length`` code points that occur
    ``least_count`` times. ``n_near`` counts the words one letter away; ``form`` is the most frequent of them (ties:
    smallest by code point) if it is ``factor`` times as frequent, else null; ``root`` is the end of the chain of
    forms. ``damage_every`` drops a letter from one of so many runs, for trials. Null and empty texts have no words;
    null identities count as empty in the damage; repeated rows count again; an empty table gives no rows; other
    columns are not read.

    A task holds HELD counts and one piece of a text; counts are summed before and after one shuffle. Signatures are a
    fixed number for each word, and the pairs of a signature are joined, never gathered.
    """
    rows = documents.select(F.col(f"`{identity}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    counts = rows.mapInArrow(*word_counts(least_length, damage_every)).groupBy("word").agg(F.sum("n").alias("n"))
    words = shared_table(counts.where(F.col("n") >= least_count), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    followed = -F.col("best.n") >= factor * F.col("n")
    named = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(followed, F.col("best.word")).alias("form"),
                                                    F.when(followed, -F.col("best.n")).alias("form_n"))
    named = shared_table(named, "named")
    ends = roots(named.where("form IS NOT NULL"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
