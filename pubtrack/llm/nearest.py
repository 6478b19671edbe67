"""Nearest vectors by inner product: inverted lists scanned with adaptive dimensions.

Vectors are grouped into lists around centroids and rotated at random, so that every block of columns
carries an equal share of an inner product on average. Within each probed list the first blocks test the
hypothesis that a candidate is as good as the worst of the best found so far: under a random rotation a
share s of the D dimensions then has the mean s * bound and the variance s * (1 - s) / (D + 2) * (product of
squared lengths + bound ** 2). A candidate that lies CERTAIN deviations below is abandoned; only the others see
further blocks. Scores are computed again on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pubtrack.llm.common import shared_table
from pubtrack.llm.mixing import global_rank

#: Lists probed, as a multiple of the number of lists to the power 0.75.
PROBES = 2.2
#: Deviations beyond which a candidate is abandoned, column blocks, rows of a list and queries that meet in one task.
CERTAIN, BLOCKS, LIST_ROWS, QUERY_ROWS = 3.0, 4, 8192, 2048
#: Below this share of live candidates the remaining blocks are computed for each of them alone.
SPARSE = 0.1


@dataclass
class Layout:
    """Centroids in the space with one more dimension, in which largest inner product is least distance."""

    centroids: np.ndarray
    rotation: np.ndarray
    norm: float

    @classmethod
    def fit(cls, vectors: np.ndarray, lists: int, norm: float, seed: int = 5, rounds: int = 12) -> Layout:
        """k-means on a sample; ``norm`` is the largest norm of all vectors."""
        draw = np.random.default_rng(seed)
        dims = vectors.shape[1]
        points = lifted(vectors, norm)
        centroids = points[draw.permutation(len(points))[:lists]].copy()
        for _ in range(rounds):
            near = assign(points, centroids)
            sums = np.zeros_like(centroids)
            np.add.at(sums, near, points)
            counts = np.bincount(near, minlength=len(centroids))
            filled = counts > 0
            centroids[filled] = sums[filled] / counts[filled, None]
        rotation, _ = np.linalg.qr(draw.standard_normal((dims, dims)))
        return cls(centroids, rotation, norm)

    def lists_of(self, vectors: np.ndarray) -> np.ndarray:
        return assign(lifted(vectors, self.norm), self.centroids)

    def probes(self, queries: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` lists with the nearest centroids of every query, nearest first (a query has no further coordinate)."""
        queries = queries / np.linalg.norm(queries, axis=1, keepdims=True) * self.norm
        flat = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
        gap = (self.centroids**2).sum(axis=1) - 2 * flat @ self.centroids.T
        return np.argsort(gap, axis=1, kind="stable")[:, :n]


def lifted(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with a coordinate that gives all of them length ``norm``."""
    rest = np.sqrt(np.maximum(norm**2 - (vectors**2).sum(axis=1), 0.0))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def assign(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids**2).sum(axis=1) / 2
    return np.concatenate([(part @ centroids.T - half).argmax(axis=1) for part in np.array_split(points, len(points) // 4096 + 1)])


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one batch as rows of doubles."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1)


def scan(queries: np.ndarray, vectors: np.ndarray, own: np.ndarray, bound: np.ndarray, rotation: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Surviving (query, vector) positions; ``own`` marks by pairs of positions what is not a candidate and ``bound``
    is the score that a query has for its ``k``-th best so far (minus infinity if it has none)."""
    q, v = queries @ rotation, vectors @ rotation
    dims = q.shape[1]
    edges = np.unique(np.linspace(0, dims, BLOCKS + 1).astype(int))
    first = min(len(v), 4 * k)
    if first >= k and np.isneginf(bound).any():
        # The first vectors are compared in full: they give every query its first bound.
        score = queries @ vectors[:first].T
        score[own[:, :first]] = -np.inf
        bound = np.maximum(bound, np.partition(score, first - k, axis=1)[:, first - k])
    lengths_q, lengths_v = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
    alive = ~own
    part = np.zeros((len(q), len(v)))
    pairs = None
    for low, high in zip(edges[:-1], edges[1:]):
        # A candidate as good as the bound has this share of it so far, give or take CERTAIN deviations.
        share = high / dims
        spread = CERTAIN * np.sqrt(share * (1 - share) / (dims + 2))
        if pairs is None:
            part += q[:, low:high] @ v[:, low:high].T
            with np.errstate(invalid="ignore"):
                least = share * bound[:, None] - spread * np.sqrt((lengths_q[:, None] * lengths_v[None, :]) ** 2 + bound[:, None] ** 2)
            alive &= ~(part < least - 1e-9 * (1 + np.abs(part)))
            if alive.mean() < SPARSE or high == dims:
                i, j = np.nonzero(alive)
                pairs, seen = True, part[i, j]
            continue
        for at in range(0, len(i), 65536):
            some = slice(at, at + 65536)
            seen[some] += np.einsum("ij,ij->i", q[i[some], low:high], v[j[some], low:high])
        with np.errstate(invalid="ignore"):
            least = share * bound[i] - spread * np.sqrt((lengths_q[i] * lengths_v[j]) ** 2 + bound[i] ** 2)
        stay = ~(seen < least - 1e-9 * (1 + np.abs(seen)))
        i, j, seen = i[stay], j[stay], seen[stay]
    return i, j


def best_of(query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, k: int) -> pa.Table:
    """At most ``k`` nearest of one list part for each query, scored on the original vectors."""
    found = []
    for at in range(0, len(query_ids), 256):
        qid, q = query_ids[at:at + 256], queries[at:at + 256]
        i, j = scan(q, vectors, qid[:, None] == ids[None, :], bounds[at:at + 256], rotation, k)
        score = np.concatenate([np.einsum("ij,ij->i", q[i[s:s + 65536]], vectors[j[s:s + 65536]]) for s in range(0, max(1, len(i)), 65536)])
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = place < k
        found.append((qid[i[keep]], ids[j[keep]], score[keep]))
    columns = [np.concatenate(c) for c in zip(*found)]
    return pa.table([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, not zero, all components known and finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(embeddings: DataFrame, query: Column, k: int = 20, sample_rows: int = 20_000, lists: int | None = None, first_probes: int = 4,
            identity: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of every row for which ``query`` (a condition on vec_id) holds: query_id, rank, vec_id, score.

    The score is the inner product of the original vectors in double precision; ties go to the smaller vec_id.
    Vectors that are null, zero or hold null or non-finite components, and rows without identity take no part. A
    query's candidates are the rows with vectors of its length but itself; every length has an index of its own. Rows
    with equal identity are rows of their own (ties between them go by a number given once). All rows are
    indexed; the centroids are fitted on at most ``sample_rows`` rows chosen by hash. A query first goes through its
    ``first_probes`` nearest lists; the score of its ``k``-th best there is the bound with which it goes through the
    others, of PROBES * lists ** 0.75 in all. Queries that find fewer than ``k`` rows so go through all lists. An empty
    table gives no rows; other columns are not read.

    A task holds at most about LIST_ROWS vectors of a list and QUERY_ROWS queries: longer lists and lists that
    more queries probe are dealt out by hash, whatever their vectors are.
    """
    given = embeddings.select(F.col(identity).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id IS NOT NULL").where(usable(F.col("v")))
    given = shared_table(given, "vectors")
    if given.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        asked = given.where(query)
        return indexed_search(given, asked, k, sample_rows, lists, first_probes)
    # Numbers in the order of the identities, so that ties between numbers are ties between identities.
    numbered = shared_table(global_rank(given, [F.col("vec_id")], "row"), "numbered")
    rows = numbered.select(F.col("row").alias("vec_id"), "v")
    found = indexed_search(rows, numbered.where(query).select(F.col("row").alias("vec_id"), "v"), k, sample_rows, lists, first_probes)
    names = numbered.select("row", F.col("vec_id").alias("name"))
    named = found.join(names.withColumnRenamed("name", "of"), F.col("query_id") == F.col("row")).drop("row").join(names, F.col("vec_id") == F.col("row"))
    return named.select(F.col("of").alias("query_id"), "rank", F.col("name").alias("vec_id"), "score")


def indexed_search(given: DataFrame, queries: DataFrame, k: int, sample_rows: int, lists: int | None, first_probes: int) -> DataFrame:
    """The nearest rows by identities that are all different, one index for each length of vectors."""
    sizes = given.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("norm"))
    shapes = sizes.orderBy("dims").collect()  # one row per length
    found = given.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for shape in shapes:
        same = F.size("v") == shape["dims"]
        found = found.union(search_length(given.where(same), queries.where(same), shape["n"], shape["norm"], k, sample_rows, lists, first_probes))
    return found


def search_length(given: DataFrame, queries: DataFrame, n: int, norm: float, k: int, sample_rows: int, lists: int | None, first_probes: int) -> DataFrame:
    """The search of :func:`nearest` over ``n`` vectors of one length."""
    share = min(1.0, 1.1 * sample_rows / n)
    drawn = given.where(F.xxhash64("vec_id") / F.lit(2.0**64) + 0.5 <= share).orderBy(F.xxhash64("vec_id")).limit(sample_rows).select("v").toArrow()
    count = lists or int(np.clip(np.sqrt(n), 1, 4096))
    layout = Layout.fit(matrix(drawn.column("v")), count, norm)
    probed = min(len(layout.centroids), int(np.ceil(PROBES * len(layout.centroids) ** 0.75)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = layout.lists_of(matrix(batch.column("v"))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(found), batch.column("v")], names=["vec_id", "list", "v"])

    def route(low: int, high: int):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    found = layout.probes(matrix(batch.column("v")), high)[:, low:].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("bound"), pa.array(list(found), pa.list_(pa.int32())), batch.column("v")],
                                                     names=["query_id", "bound", "probes", "v"])
        return run

    def part_best(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return best_of(np.asarray(asked.column("query_id")), matrix(asked.column("v")), np.asarray(asked.column("bound")), np.asarray(held.column("vec_id")), matrix(held.column("v")), layout.rotation, k)

    indexed = shared_table(given.mapInArrow(place, "vec_id long, list int, v array<double>"), "lists")
    parts = indexed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).cast("int").alias("parts"))
    queries = queries.withColumn("bound", F.lit(float("-inf")))

    def search(some: DataFrame, low: int, high: int) -> DataFrame:
        routed = some.select("vec_id", "bound", "v").mapInArrow(route(low, high), "query_id long, bound double, probes array<int>, v array<double>")
        routed = shared_table(routed.select("query_id", "bound", "v", F.explode("probes").alias("list")), "routed")
        asked = routed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("shares")).join(parts, "list")
        asked = F.broadcast(asked)  # one row per list, at most 4,096
        deal = lambda c, m: F.pmod(F.xxhash64(c), F.col(m)).cast("int")
        left = routed.join(asked, "list").select("query_id", "bound", "v", "list", deal("query_id", "shares").alias("share"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        right = indexed.join(asked, "list").select("vec_id", "v", "list", deal("vec_id", "parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
        keys = ["list", "share", "part"]
        return shared_table(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(part_best, "query_id long, vec_id long, score double"), "found")

    def best(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = min(first_probes, probed)
    found = search(queries, 0, near)
    if near < probed:
        bounds = best(found).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
        found = found.union(search(queries.drop("bound").join(bounds, "vec_id", "left").fillna(float("-inf"), ["bound"]), near, probed))
    enough = found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = queries.join(enough, "vec_id", "left_anti")
    if probed < len(layout.centroids) and not short.isEmpty():
        found = found.union(search(short, probed, len(layout.centroids)))
    return best(found).select("query_id", "rank", "vec_id", "score")
