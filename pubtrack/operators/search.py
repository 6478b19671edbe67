"""Batch search: trigram postings, texts met by blocks of queries, bounded result pages."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubtrack.functions.text import alphanumerics, by_length, probe_grams, token_needs, tokens, trigrams
from pubtrack.operators.scan import top_per_key
from pubtrack.session import BROADCAST_ROWS, cut, is_small

PAGE = 20
#: Queries and records in a block of a large query set, about.
SHORT_LIST, BLOCK_RECORDS = 65_536, 4096
#: Records whose matches are given out at once.
MATCHED_AT_ONCE = 256
#: Pieces of a text, and their longest, whose words a task remembers.
PIECES_KEPT, LONGEST_KEPT = 100_000, 64


def parse_queries(queries: DataFrame, identity: str, folded: str, max_tokens: int | None = None, max_chars: int | None = None,
                  keep: Sequence[str] = ()) -> DataFrame:
    """Tokens, probe grams and validity of every query.

    ``kind``: ``number`` for a whole list number of 7 or 8 digits, ``name`` for a text with at least
    one token of three characters, ``too_short`` without one, ``invalid`` for wildcards, for fewer than three
    letters or digits and, where limits are given, beyond ``max_tokens`` or ``max_chars``.
    """
    text = F.col(folded)
    words = tokens(text)
    invalid = (alphanumerics(text) < 3) | F.rlike(text, F.lit(r"[%_\\]"))
    if max_tokens is not None:
        invalid = invalid | (F.size(words) > max_tokens)
    if max_chars is not None:
        invalid = invalid | (F.length(text) > max_chars)
    long_words = by_length(F.filter(F.array_distinct(words), lambda w: F.length(w) >= 3))
    kind = (F.when(F.coalesce(invalid, F.lit(True)), "invalid").when(F.rlike(text, F.lit(r"^\d{7,8}$")), "number")
            .when(F.size(long_words) == 0, "too_short").otherwise("name"))
    return queries.select(identity, *keep, text.alias("query"), words.alias("words"), token_needs(words).alias("needs"), long_words.alias("long_words"), kind.alias("kind"),
                          probe_grams(long_words).alias("grams"))


def postings(corpus: DataFrame, identity: str, text: str) -> DataFrame:
    """Inverted index: one row per distinct trigram and record."""
    return corpus.select(identity, F.explode(trigrams(F.col(text))).alias("gram"))


def missing_postings(corpus: DataFrame, indexed: DataFrame, identity: str) -> DataFrame:
    """Records without postings yet; the index is complete when there are none."""
    return corpus.join(indexed.select(identity).distinct(), identity, "left_anti")


def gram_sizes(index: DataFrame) -> DataFrame:
    """Posting-list length per gram."""
    return index.groupBy("gram").agg(F.count(F.lit(1)).alias("posting_size"))


def rarest_gram(parsed: DataFrame, identity: str, sizes: DataFrame) -> DataFrame:
    """The probe gram with the shortest posting list; a gram nobody holds has length 0."""
    probes = parsed.where(F.col("kind") == "name").select(identity, F.posexplode("grams").alias("_pos", "gram"))
    sized = probes.join(sizes, "gram", "left").withColumn("posting_size", F.coalesce("posting_size", F.lit(0)))
    best = F.struct("posting_size", "_pos")
    return sized.groupBy(identity).agg(F.min_by("gram", best).alias("gram"), F.min("posting_size").alias("posting_size"))


def matcher(long_words: Sequence[Sequence[str]], needs: Sequence[Sequence[tuple[str, int]]]) -> Callable[[str], Iterator[tuple[int, bool]]]:
    """For a text, the numbers of the queries all of whose long words it holds, and whether it meets their needs. Words are
    looked for in every distinct piece between white space, and only if a trigram of theirs is there; what frequent pieces hold is
    remembered. A query is looked at only if its word that the fewest queries share was found."""
    grams = lambda text: {text[i:i + 3] for i in range(len(text) - 2)}
    users = Counter(word for words in long_words for word in words)
    common = Counter(gram for word in users for gram in grams(word))
    by_gram, by_word = defaultdict(list), defaultdict(list)
    for word in users:
        by_gram[min(grams(word), key=lambda g: (common[g], g))].append(word)
    for number, words in enumerate(long_words):
        # The other words, and the needs that holding the long words does not meet.
        least = min(words, key=lambda w: (users[w], -len(w)))
        by_word[least].append((number, frozenset(words) - {least}, [(t, n) for t, n in needs[number] if n > 1 or t not in users]))

    def look(piece: str) -> tuple[str, ...]:
        return tuple(word for gram in by_gram.keys() & grams(piece) for word in by_gram[gram] if word in piece)

    inside = lru_cache(PIECES_KEPT)(look)

    def met(text: str) -> Iterator[tuple[int, bool]]:
        # Words hold no white space, so one is in the text if it is in a piece.
        held = set().union(*[inside(piece) if len(piece) <= LONGEST_KEPT else look(piece) for piece in set(text.split())])
        counted = {}
        for word in by_word.keys() & held:
            for number, others, rest in by_word[word]:
                if others <= held:
                    ok = True
                    for t, n in rest:
                        if t not in counted:
                            counted[t] = text.count(t)
                        if counted[t] < n:
                            ok = False
                            break
                    yield number, ok

    return met


def matched(queries: pa.Table, query: str, record: str, text: str, scope: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step over batches of records: a row for every query and record that holds its long words, with the other columns
    of the record and ``_verified``."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = matcher(queries["long_words"].to_pylist(), [[(s["t"], s["n"]) for s in needs] for needs in queries["needs"].to_pylist()])
        asked, scopes = queries[query].combine_chunks(), queries["_scope"].to_pylist() if scope else None
        for batch in batches:
            for part in (batch.slice(at, MATCHED_AT_ONCE) for at in range(0, batch.num_rows, MATCHED_AT_ONCE)):
                places = part.column(scope).to_pylist() if scope else None
                found = [(row, number, ok) for row, value in enumerate(part.column(text).to_pylist()) if value is not None for number, ok in met(value)
                         if not scope or scopes[number] is None or scopes[number] == places[row]]
                at = pa.array([f[0] for f in found], pa.int64())
                kept = [c for c in part.schema.names if c != text]
                yield pa.RecordBatch.from_arrays([asked.take(pa.array([f[1] for f in found], pa.int64())), *[part.column(c).take(at) for c in kept], pa.array([f[2] for f in found], pa.bool_())],
                                                 names=[query, *kept, "_verified"])

    return rows


def search_names(corpus: DataFrame, record: str, text: str, parsed: DataFrame, query: str, order: Sequence[Column],
                 page: int = PAGE, broad: int | None = None, broadcast_rows: int = BROADCAST_ROWS,
                 scope: str | None = None, skip: int = 0) -> tuple[DataFrame, DataFrame]:
    """Result rows and outcome per query.

    A record is a candidate when it holds every long token, and a result when every token occurs as often as
    the query repeats it. ``scope`` names a column of records and queries: a query that has a value there meets only
    records with the same value. Every query gets its first ``page`` results after the first ``skip``; with ``broad``, the outcome of a query with
    more candidates than that is ``too_broad``, as a hint to narrow it.

    A small query set goes to every task, so no text is shuffled. A large one is dealt into blocks of SHORT_LIST and the
    records into blocks of about BLOCK_RECORDS; every pair of blocks is one group, so a text is shuffled once for each block of
    queries and no pair of a query and a record is stored that is not a candidate. Candidates are counted with a map-side combine and
    pages are cut before their shuffle, so popular words do not gather anywhere.
    """
    parsed = cut(parsed)
    names = parsed.where(F.col("kind") == "name").select(query, "needs", "long_words", *([F.col(scope).alias("_scope")] if scope else []))
    candidates = cut(candidate_rows(corpus, record, text, names, query, scope, broadcast_rows))
    counts = candidates.groupBy(query).agg(F.count(F.lit(1)).alias("candidates"), F.count_if("_verified").alias("matches"))
    outcomes = parsed.join(counts, query, "left").select(
        query, "kind", F.coalesce("candidates", F.lit(0)).alias("candidates"),
        F.when(F.col("kind") == "number", "number").when(F.col("kind") != "name", F.col("kind"))
        .when(F.lit(broad is not None) & (F.col("candidates") > (broad or 0)), "too_broad").otherwise("ok").alias("outcome"),
        F.coalesce(F.col("matches") > skip + page, F.lit(False)).alias("more"))
    hits = top_per_key(candidates.where("_verified").drop("_verified"), [query], order, skip + page)
    return hits.where(F.col("position") > skip), outcomes


def candidate_rows(corpus: DataFrame, record: str, text: str, names: DataFrame, query: str, scope: str | None = None,
                   broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every query of ``names`` with the records that hold its long words: query, record, order columns, ``_verified``. What is kept
    of a record is its key, never its text."""
    others = order_columns(corpus, record, text)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in
                      [names.schema[query], *[corpus.schema[c] for c in (record, *others)]]) + ", _verified boolean"
    corpus = corpus.select(record, *others, text)
    if is_small(names, broadcast_rows):
        return corpus.mapInArrow(matched(names.toArrow(), query, record, text, scope), shape)
    query_blocks, record_blocks = names.count() // SHORT_LIST + 1, corpus.count() // BLOCK_RECORDS + 1
    block = lambda key, blocks: F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = names.withColumn("_q", block(query, query_blocks)).withColumn("_r", every(record_blocks))
    given = corpus.withColumn("_r", block(record, record_blocks)).withColumn("_q", every(query_blocks))

    def meet(queries: pa.Table, records: pa.Table) -> pa.Table:
        held = records.drop_columns(["_q", "_r"])
        kept = [held.schema.field(c) for c in (record, *others)]
        form = pa.schema([queries.schema.field(query), *kept, pa.field("_verified", pa.bool_())])
        return pa.Table.from_batches(matched(queries, query, record, text, scope)(iter(held.to_batches())) if queries.num_rows else [], form)

    return asked.groupBy("_q", "_r").cogroup(given.groupBy("_q", "_r")).applyInArrow(meet, shape)


def order_columns(corpus: DataFrame, record: str, text: str) -> list[str]:
    """Corpus columns besides the id and the text."""
    return [c for c in corpus.columns if c not in (record, text, "gram")]


def search_numbers(corpus: DataFrame, number: str, parsed: DataFrame, query: str) -> DataFrame:
    """Whole list numbers: an equality join."""
    wanted = parsed.where(F.col("kind") == "number").select(query, F.col("query").alias(number))
    return corpus.join(wanted, number)


def rank_key(column: Column) -> Column:
    """Records without a rank come after all ranked ones."""
    return F.coalesce(column, F.lit(2147483647))
