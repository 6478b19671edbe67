"""Near-duplicate documents by a chosen-path join over minwise tokens.

A document is the set of its word shingles. Its minwise tokens (the least hash under each of COORDINATES
functions) agree between two sets with a probability equal to their Jaccard similarity. Each of several
trees starts with all sets in the root; the root sends every member to the children named by the member's
tokens at ROOT_CHILDREN coordinates, a further node to those at NODE_CHILDREN, all different and chosen by
hash. Small nodes compare all members. A large node compares its members with one pivot. If that does not
connect them all, it is settled by the tokens of its members if it has at most DENSE_NODE of them or branching did
not halve it, and branched further otherwise. To settle a node, all pairs that are not connected are compared by
their tokens inside a task; the few that can be similar enough are named, and where they are many, as among
thousands of texts around a common part, the members are compared on their full sets block by block. A pair is
settled in the first such node of the first level in which it meets. :func:`miss` bounds the probability that a
linked pair meets in no node of a level.

Equal sets are joined beforehand, a comparison of tokens discards pairs that cannot be similar enough, and
every link is confirmed on the full sets (64-bit shingle hashes).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pubtrack.llm.common import SPACE, components, lean, packed, perhaps, shared_table, slices, texts_of
from pubtrack.llm.shingles import mixed, words_of
from pubtrack.operators.scan import estimated_bytes

COORDINATES, TREES, SMALL_NODE, DENSE_NODE = 64, 10, 32, 4096
#: Children that a member goes to from the root and from every further node.
ROOT_CHILDREN, NODE_CHILDREN = 2, 2
#: Candidate pairs that a settled node names, for each of its members; with more it names the members.
NAMED = 4
#: Members and bytes of text of a block of a dense node; two blocks meet in one task.
BLOCK, BLOCK_BYTES = 2048, 4 << 20
#: Estimated size of a table of texts from which those that a join needs are told beforehand.
FILTERED_BYTES = 32 << 20
#: Least number of equal token bytes of a pair that is compared in full: a pair at similarity 0.75 has 48 on
#: average and fewer than 28 with probability 1e-8.
LEAST_EQUAL = 28

_DRAW = np.random.default_rng(20)
MULTIPLIERS = (_DRAW.integers(0, 1 << 32, COORDINATES, dtype=np.uint32) | np.uint32(1))[:, None]
OFFSETS = _DRAW.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)[:, None]


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``k``-word shingles of each text; fewer words are one shingle, none are no set."""
    words = words_of(texts, lower=True)
    hashes, _ = words.windows(k)
    sets = []
    for low, high in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        n = high - low
        if n >= k:
            sets.append(np.unique(hashes[low:high - k + 1]))
        elif n:
            whole = np.uint64(n)
            for h in words.hashes[low:high]:
                whole = mixed(whole * np.uint64(3) + h)
            sets.append(np.array([whole], dtype=np.uint64))
        else:
            sets.append(np.empty(0, dtype=np.uint64))
    return sets


def prints(k: int):
    """Arrow function: identity, tag of the text, set size, 128-bit print of the set and its minwise tokens."""
    form = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("n", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for part in slices(batches, "text"):
                rows = []
                for s in shingle_sets([t.encode() for t in part.column("text").to_pylist()], k):
                    if len(s):
                        p1, p2 = int(mixed(s).sum().view(np.int64)), int(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64))
                        low = (s >> np.uint64(32)).astype(np.uint32)
                        rows.append((len(s), p1, p2, (MULTIPLIERS * low + OFFSETS).min(axis=1).tobytes()))
                    else:
                        rows.append((0, None, None, None))
                columns = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tag"), *[pa.array(list(c), f.type) for c, f in zip(columns, list(form)[2:])]], schema=form)

    return lean(run), "doc_id long, tag long, n long, p1 long, p2 long, tokens binary"


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def sketch_matrix(column: pa.Array) -> np.ndarray:
    """One row of token bytes (the lowest byte of each token) per entry."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES)


def star_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (member, pivot) of large nodes that may be similar enough."""
    for batch in batches:
        if batch.num_rows:
            equal = (sketch_matrix(batch.column("sketch")) == sketch_matrix(batch.column("pivot_sketch"))).sum(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(equal >= LEAST_EQUAL))


def node_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of a small node that may be similar enough."""
    for batch in batches:
        left, right = [], []
        for ids, sketches in zip(batch.column("ids"), batch.column("sketches")):
            ids = np.array(ids.as_py(), dtype=np.int64)
            rows = sketch_matrix(sketches.values)
            i, j = np.triu_indices(len(ids), 1)
            near = (rows[i] == rows[j]).sum(axis=1) >= LEAST_EQUAL
            left.append(np.maximum(ids[i[near]], ids[j[near]]))
            right.append(np.minimum(ids[i[near]], ids[j[near]]))
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], schema=PAIRS)


def open_pairs(first: list[int]):
    """Arrow function over the members of one node (or of two blocks of it): the unconnected pairs that may be similar
    enough, as (null, a, b), or, if they are more than NAMED for each member, their members as (group, a, null).

    ``first`` has the coordinates of the nodes of the first level in order. ``mask`` tells which of its nodes of the
    first level a member has seen settled; pairs that meet in an earlier one of these are left to it.
    """
    form = pa.schema([("node", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(held: pa.Table) -> pa.Table:
        ids, component, mask, block = (np.asarray(held.column(c)) for c in ("cid", "component", "mask", "block"))
        root, low, high = (held.column(c)[0].as_py() for c in ("root", "low", "high"))
        tokens = np.frombuffer(b"".join(held.column("tokens").to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)
        sketch = np.ascontiguousarray(tokens.astype(np.uint8).T)
        left, right = [], []
        for at in range(0, len(ids), 256):
            some, rest = slice(at, at + 256), slice(at, None)
            equal = np.zeros((len(ids[some]), len(ids[rest])), dtype=np.uint8)
            for row in sketch:
                equal += row[some, None] == row[None, rest]
            met = (equal >= LEAST_EQUAL) & (component[some, None] != component[None, rest])
            if low != high:
                met &= block[some, None] != block[None, rest]
            i, j = np.nonzero(np.triu(met, 1))
            i, j = i + at, j + at
            for number, coordinate in enumerate(first[:root] if root >= 0 else first):
                fresh = (tokens[i, coordinate] != tokens[j, coordinate]) | (mask[i] >> number & 1 == 0)
                i, j = i[fresh], j[fresh]
            left.append(i)
            right.append(j)
        i, j = np.concatenate(left), np.concatenate(right)
        if len(i) <= NAMED * len(ids):
            a, b = ids[i], ids[j]
            return pa.Table.from_arrays([pa.nulls(len(i), pa.int64()), pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], schema=form)
        members = ids[np.unique(np.concatenate([i, j]))]
        return pa.Table.from_arrays([pa.array([held.column("group")[0].as_py()] * len(members), pa.int64()), pa.array(members), pa.nulls(len(members), pa.int64())], schema=form)

    return run


def settled(rest: DataFrame, classes: DataFrame, first: list[int], masks: DataFrame) -> DataFrame:
    """What :func:`open_pairs` finds in the open nodes ``rest`` (node, root, cid, m, component), stored. A node of more than
    DENSE_NODE members is cut into blocks, of which every two meet."""
    blocks = F.when(F.col("m") > DENSE_NODE, F.ceil(F.col("m") * 2 / DENSE_NODE)).otherwise(1).cast("int")
    own = rest.join(classes.select("cid", "tokens"), "cid").join(masks, "cid", "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("long")))
    own = own.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("node", "root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "cid", "component", "tokens", "mask")
    met = met.withColumn("group", F.xxhash64("node", "low", "high"))
    return shared_table(met.groupBy("node", "low", "high").applyInArrow(open_pairs(first), "node long, a long, b long"), "settled")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs. Shingles of few sets are counted pair by pair, the others by
    products of slices of the incidence matrix."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    hashes = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    group = np.cumsum(np.r_[True, hashes[1:] != hashes[:-1]]) - 1 if len(hashes) else owner
    size = np.bincount(group)[group] if len(hashes) else owner
    counts = np.zeros((n, n), dtype=np.int64)
    rare = np.flatnonzero((size > 1) & (size <= 16))
    for step in range(1, 16):
        met = np.flatnonzero(group[rare[step:]] == group[rare[:-step]]) if len(rare) > step else rare[:0]
        counts += np.bincount(owner[rare[met]] * n + owner[rare[met + step]], minlength=n * n).reshape(n, n)
    counts += counts.T
    popular = size > 16
    column = np.unique(group[popular], return_inverse=True)[1]
    rows = owner[popular]
    for low in range(0, int(column.max(initial=-1)) + 1, 4096):
        some = (column >= low) & (column < low + 4096)
        matrix = np.zeros((n, min(4096, int(column.max()) + 1 - low)), dtype=np.float32)
        matrix[rows[some], column[some] - low] = 1
        counts += np.rint(matrix @ matrix.T).astype(np.int64)
    return counts


def block_links(k: int, percent: int):
    """Arrow function over two blocks of a dense node (or one): links that connect different components, one
    for each connection that the earlier ones do not imply."""
    def run(held: pa.Table) -> pa.Table:
        ids, component = (np.asarray(held.column(c)) for c in ("cid", "component"))
        with np.errstate(over="ignore"):
            sets = [s for t in held.column("text").to_pylist() for s in shingle_sets([t.encode()], k)]
        sizes = np.array([len(s) for s in sets])
        counts = common_counts(sets)
        linked = np.triu(100 * counts >= percent * (sizes[:, None] + sizes[None, :] - counts), 1)
        i, j = np.nonzero(linked & (component[:, None] != component[None, :]))
        low, high = np.minimum(component[i], component[j]), np.maximum(component[i], component[j])
        _, once = np.unique(np.stack([low, high], axis=1), axis=0, return_index=True)
        root: dict[int, int] = {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        kept = []
        for at in once.tolist():
            x, y = find(int(low[at])), find(int(high[at]))
            if x != y:
                root[max(x, y)] = min(x, y)
                kept.append(at)
        a, b = ids[i[kept]], ids[j[kept]]
        return pa.Table.from_arrays([pa.array(np.maximum(a, b), pa.int64()), pa.array(np.minimum(a, b), pa.int64())], schema=PAIRS)

    return run


def dense_links(dense: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between the unconnected members of groups (node, cid, component), compared block by block on
    their full sets; a block has at most BLOCK members and, on average, BLOCK_BYTES of text."""
    if estimated_bytes(texts) > FILTERED_BYTES:
        dense = stored_ids(dense, "dense")
        count = dense.count()
        if not count:
            return dense.select(F.col("cid").alias("a"), F.col("cid").alias("b"))
        texts = perhaps(texts, "cid", dense.select("cid"), count)
    held = dense.join(texts, "cid")
    bulk = held.groupBy("node").agg(F.sum(F.length("text")).alias("bulk"), F.count(F.lit(1)).alias("m"))
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("bulk") / BLOCK_BYTES)).cast("int")
    own = held.join(bulk, "node").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("node", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "cid", "component", "text")
    return met.groupBy("node", "low", "high").applyInArrow(block_links(k, percent), "a long, b long")


def confirm(k: int, percent: int):
    """Arrow function: the pairs with 100 * intersection >= percent * union of the full sets."""
    def run(batches):
        with np.errstate(over="ignore"):
            for part in slices(batches, "text_a", "text_b"):
                texts = [t.encode() for c in ("text_a", "text_b") for t in part.column(c).to_pylist()]
                sets = shingle_sets(texts, k)
                linked = []
                for a, b in zip(sets[:part.num_rows], sets[part.num_rows:]):
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    linked.append(100 * common >= percent * (len(a) + len(b) - common))
                yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return lean(run), "a long, b long"


def sketch(tokens) -> F.Column:
    """The lowest byte of each token."""
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8 * COORDINATES), F.lit(8)), lambda i: F.substring(F.hex(tokens), i, F.lit(2))), ""))


def miss(level: int, similarity: float = 0.75) -> float:
    """Probability that a pair meets in no node of ``level`` (from 1) of any tree, if every node above is branched.

    All trees read the same tokens, so they are independent only once it is given at how many coordinates the pair
    agrees, which is binomial. A node draws different coordinates by its own hash; below each child whose
    coordinate agrees, the pair goes on with the chance of one level less.
    """
    def meets(below: float, agree: int, children: int) -> float:
        return 1 - sum(comb(agree, j) * comb(COORDINATES - agree, children - j) / comb(COORDINATES, children) * (1 - below) ** j for j in range(children + 1))

    total = 0.0
    for agree in range(COORDINATES + 1):
        chance = 1.0
        for _ in range(level - 1):
            chance = meets(chance, agree, NODE_CHILDREN)
        missed = (1 - meets(chance, agree, ROOT_CHILDREN)) ** TREES
        total += comb(COORDINATES, agree) * similarity**agree * (1 - similarity) ** (COORDINATES - agree) * missed
    return total


def child(node, coordinate) -> F.Column:
    """The child that a member's token at ``coordinate`` names."""
    return F.xxhash64(node, coordinate, F.substring(F.col("tokens"), (coordinate * 4 + 1).cast("int"), F.lit(4)))


def drawn(node: F.Column, count: int) -> list[F.Column]:
    """``count`` different coordinates, at most three, that the hash of ``node`` chooses."""
    first = F.pmod(F.xxhash64(node, F.lit("first")), F.lit(COORDINATES))
    second = F.pmod(first + 1 + F.pmod(F.xxhash64(node, F.lit("second")), F.lit(COORDINATES - 1)), F.lit(COORDINATES))
    place = F.pmod(F.xxhash64(node, F.lit("third")), F.lit(COORDINATES - 2))
    place = place + F.when(place >= F.least(first, second), 1).otherwise(0)
    return [first, second, place + F.when(place >= F.greatest(first, second), 1).otherwise(0)][:count]


def first_nodes(classes: DataFrame) -> DataFrame:
    """(node, root, cid, parent_m) of the children of every root; ``root`` numbers them over all trees."""
    trees = classes.select("cid", "tokens", F.explode(F.sequence(F.lit(1), F.lit(TREES))).alias("tree"))
    nodes = F.array(*[child(F.col("tree"), c) for c in drawn(F.col("tree"), ROOT_CHILDREN)])
    found = trees.select("cid", "tree", F.posexplode(nodes).alias("place", "node"))
    return found.select("node", (F.col("place") + (F.col("tree") - 1) * ROOT_CHILDREN).alias("root"), "cid", F.lit(1 << 62).alias("parent_m"))


def first_coordinates(spark) -> list[int]:
    """The coordinates of the children of all roots, in the order of ``root``: a fixed number of constants."""
    tree = F.col("tree")
    rows = spark.range(1, TREES + 1).select(F.col("id").cast("int").alias("tree")).select("tree", F.array(*drawn(tree, ROOT_CHILDREN)).alias("at")).orderBy("tree").collect()
    return [int(c) for r in rows for c in r["at"]]


def next_nodes(rest: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, root, cid, parent_m) of the children of every member of nodes (node, cid, m)."""
    nodes = F.array(*[child(F.col("node"), c) for c in drawn(F.col("node"), NODE_CHILDREN)])
    return rest.join(classes.select("cid", "tokens"), "cid").select(F.explode(nodes).alias("node"), F.lit(-1).alias("root"), "cid", F.col("m").alias("parent_m"))


def same_component(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Drop the pairs whose ends are already connected."""
    if labels is None:
        return pairs
    a, b = labels.select(F.col("id").alias("a"), F.col("component").alias("ca")), labels.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    return pairs.join(a, "a", "left").join(b, "b", "left").where("ca IS NULL OR cb IS NULL OR ca <> cb").select("a", "b")


def stored_ids(ids: DataFrame, name: str) -> DataFrame:
    """A table of identities, stored in as many files as there are cores at most."""
    return shared_table(ids.coalesce(ids.sparkSession.sparkContext.defaultParallelism), name)


def linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough, stored. Of a large table of texts only those of these pairs are shuffled."""
    ends = [texts, texts]
    if estimated_bytes(texts) > FILTERED_BYTES:
        pairs = stored_ids(pairs.select("a", "b"), "pairs")
        count = pairs.count()
        if not count:
            return pairs
        ends = [perhaps(texts, "cid", pairs.select(c), count) for c in "ab"]
    a, b = (end.select(F.col("cid").alias(c), F.col("text").alias(f"text_{c}")) for c, end in zip("ab", ends))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    return shared_table(both.mapInArrow(*confirm(k, percent)), "links")


def connect(labels: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """Labels (id, component) after adding links; those known so far stand for the links behind them."""
    if labels is None:
        return shared_table(components(fresh), "labels")
    if fresh.isEmpty():
        return labels
    return shared_table(components(fresh.union(labels.select(F.col("id").alias("a"), F.col("component").alias("b")))), "labels")


def number(identity) -> F.Column:
    """The identity as a join key; rows of equal tags have equal texts, so a null one may meet a zero."""
    return F.coalesce(identity, F.lit(0).cast("long"))


def classified(documents: DataFrame, identity: str, text: str, k: int, percent: int) -> DataFrame:
    """The rows of :func:`near_components` with a tag of the text and a number of the component."""
    rows = texts_of(documents, identity, text)
    tagged = rows.withColumn("tag", F.xxhash64("text"))
    printed = shared_table(tagged.mapInArrow(*prints(k)), "prints")
    # Every set is read from the text of one of its rows.
    own = F.min(F.struct("tag", "doc_id")).alias("own")
    classes = printed.where("n > 0").groupBy("p1", "p2").agg(F.min("doc_id").alias("doc_id"), F.first("tokens").alias("tokens"), own)
    classes = shared_table(classes.withColumn("sketch", sketch(F.col("tokens"))).withColumn("cid", F.monotonically_increasing_id()), "classes")
    small = classes.select("cid", "sketch")

    labels = texts = None
    members, first_at = first_nodes(classes), first_coordinates(rows.sparkSession)
    while True:
        sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.min("cid").alias("pivot")).where("m > 1")
        nodes = shared_table(members.join(sizes, "node"), "nodes")
        large = nodes.where(F.col("m") > SMALL_NODE)
        stars = large.where("cid <> pivot").select(F.col("cid").alias("a"), F.col("pivot").alias("b")).distinct()
        stars = stars.join(small.withColumnRenamed("cid", "a"), "a").join(small.select(F.col("cid").alias("b"), F.col("sketch").alias("pivot_sketch")), "b")
        tight = nodes.where(F.col("m") <= SMALL_NODE).join(small, "cid").groupBy("node").agg(
            F.collect_list(F.struct("cid", "sketch")).alias("of")).select(F.col("of.cid").alias("ids"), F.col("of.sketch").alias("sketches"))
        pairs = stars.mapInArrow(lean(star_pairs), "a long, b long").union(tight.mapInArrow(lean(node_pairs), "a long, b long"))
        pairs = shared_table(same_component(pairs.distinct(), labels), "pairs")
        top = texts is None
        if top:
            wanted = pairs.select("a").union(pairs.select("b")).union(large.select("cid")).distinct()
            own = classes.join(wanted.withColumnRenamed("a", "cid"), "cid", "left_semi").select("cid", F.col("own.tag").alias("tag"), number(F.col("own.doc_id")).alias("number"))
            found = tagged.select("tag", number(F.col("doc_id")).alias("number"), "text")
            if estimated_bytes(found) > FILTERED_BYTES:
                own = stored_ids(own, "own")
                found = perhaps(found, "tag", own.select("tag"), own.count())
            found = found.join(own, ["tag", "number"])
            texts = shared_table(found.groupBy("tag", "number", "cid").agg(F.first("text").alias("text")).select("cid", "text"), "texts")
            # First one pair per set, then only what these links leave unconnected.
            first = pairs.groupBy("a").agg(F.min("b").alias("b"))
            labels = connect(labels, linked(first, texts, k, percent))
            pairs = same_component(pairs.join(first, ["a", "b"], "left_anti"), labels)
        labels = connect(labels, linked(pairs, texts, k, percent))
        named = large.join(labels.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        apart = named.groupBy("node").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("node")
        rest = shared_table(named.join(apart, "node", "left_semi").select("node", "root", "cid", "m", "parent_m", "component"), "open")
        now = (F.col("m") <= DENSE_NODE) | (2 * F.col("m") > F.col("parent_m"))
        if top:
            masks = shared_table(rest.where(now).groupBy("cid").agg(F.bit_or(F.expr("shiftleft(1L, root)")).alias("mask")), "masks")
        found = settled(rest.where(now), classes, first_at, masks)
        sparse = linked(found.where("node IS NULL").select("a", "b").distinct(), texts, k, percent)
        close = found.where("node IS NOT NULL").select("node", F.col("a").alias("cid"))
        close = close.join(labels.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        labels = connect(labels, sparse.union(shared_table(dense_links(close, texts, k, percent), "links")))
        rest = rest.where(~now)
        if rest.isEmpty():
            break
        members = next_nodes(rest, classes)

    of_class = classes.select("p1", "p2", "cid", "doc_id").join(labels.withColumnRenamed("id", "cid"), "cid", "left").withColumn(
        "component", F.coalesce("component", "cid"))
    least = of_class.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = shared_table(of_class.join(least, "component").select("p1", "p2", "component", "component_id"), "components")
    placed = printed.join(of_class, ["p1", "p2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return placed.select("doc_id", "tag", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "component")


def near_components(documents: DataFrame, identity: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept.

    Words are cut at white space after lower-casing A-Z; ``component_id`` is the smallest identity that can be
    reached over links (null only if all are). Null and wordless texts have no shingles and stay alone. Rows with
    equal identity are rows of their own; equal texts are connected. An empty table gives no rows; other columns
    are not read.

    What meets in one task is a node of at most SMALL_NODE sets, the tokens of DENSE_NODE sets, two blocks of texts,
    or a pair. Large nodes first pair their members with a pivot only; once these links connect a group, the rest is not
    compared. A level has at most NODE_CHILDREN rows for each row of the nodes above that are branched, and these are
    halved from level to level, so there are at most log2 of (rows / DENSE_NODE) + 2 levels.
    """
    found = classified(documents, identity, text, k, percent)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def keep_representatives(documents: DataFrame, identity: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """One row of each group of :func:`near_components`, with all columns of ``documents``: one with the smallest identity.

    Rows whose text is null or has no word are linked with nothing and all stay, repeated ones too. Of the rows of a group
    that have its smallest identity, a null one only if it has no other, one stays, chosen by its text. An empty table
    gives no rows. A row travels as one struct, so columns may have any names.
    """
    found = classified(documents, identity, text, k, percent).where("kept AND n_shingles > 0")
    chosen = found.groupBy("component").agg(F.min(F.struct("tag", "doc_id")).alias("one")).select(F.col("one.tag").alias("keep_tag"), F.col("one.doc_id").alias("keep_id"))
    told = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    unnamed = F.col("doc_id").isNull().alias("unnamed")
    rows = documents.select(packed(documents), F.col(f"`{identity}`").cast("long").alias("doc_id"), F.xxhash64(told).alias("tag"), told.rlike(f"[^{SPACE}]").alias("worded"))
    # The join and the window have the same keys, so the documents are shuffled once.
    keys = ["tag", "number", "unnamed"]
    of_group = chosen.select(F.col("keep_tag").alias("tag"), number(F.col("keep_id")).alias("number"), F.col("keep_id").isNull().alias("unnamed"))
    met = rows.where("worded").select("record", "tag", number(F.col("doc_id")).alias("number"), unnamed).join(of_group, keys)
    one = met.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("tag"))).where("place = 1")
    return one.select("record").union(rows.where("NOT worded").select("record")).select("record.*")
