"""Merkle manifest of a table by time-forward processing.

Rows are leaves; per group (``lang``) every FAN consecutive nodes become one digest until one is left, and the
groups' subroots become the root in the same way. Nodes are labelled so that every child comes before its parent.
A sweep in the order of the labels computes a node from the digests that its children sent it through a priority
queue, and sends its own on to the parent; a second sweep in reverse order starts at the root and sends every child
what stands above it, so that proofs arrive at the leaves. The queue is external: inside a slice of SLICE
consecutive nodes it is a heap, which never holds more than FAN messages a level, and what leaves a slice is
stored in a shared table, sorted by Spark to the slice that reads it in the next round.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pubtrack.llm.common import shared_table
from pubtrack.session import small_side

#: Children of a node; levels of a slice and its leaves.
FAN, DEPTH = 8, 4
SLICE = FAN**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(values: Sequence[Column]) -> Column:
    """Digest of a row: every value as its byte count, a colon and its text; null as a hyphen."""
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (v.cast("string") for v in values)]
    return F.sha2(F.concat(*parts), 256)


def joined(digests: Sequence[str]) -> str:
    """Digest of a node from its children's, as hex text."""
    return sha256("".join(digests).encode()).hexdigest()


def height_of(n: int, held: int) -> int:
    """Levels that a slice of ``held`` nodes climbs: to its single node if it is the only slice of its ``n`` nodes."""
    if n > SLICE:
        return DEPTH
    height = 0
    while held > 1:
        held, height = -(-held // FAN), height + 1
    return height


def forward(digests: Sequence[str], height: int) -> list[list[str]]:
    """Digests by level. Nodes are visited by label (last leaf below, level): once a leaf is passed, every node that
    ends with it has received all its children."""
    n = len(digests)
    levels: list[list[str]] = [[] for _ in range(height + 1)]
    queue: list[tuple[int, int, int, str]] = []

    def visit(level: int, place: int, digest: str) -> None:
        levels[level].append(digest)
        if level < height:
            last = min((place // FAN + 1) * FAN ** (level + 1), n) - 1
            heappush(queue, (last, level + 1, place, digest))

    for leaf, digest in enumerate(digests):
        visit(0, leaf, digest)
        while queue and queue[0][0] == leaf:
            last, level, place, first = heappop(queue)
            run = [first]
            while queue and queue[0][:2] == (last, level):
                run.append(heappop(queue)[3])
            visit(level, place // FAN, joined(run))
    return levels


def backward(levels: list[list[str]], above: tuple) -> list[tuple]:
    """What stands above every leaf: (place in its run, the run's other digests) level by level, up to ``above``.
    Nodes are visited in reverse order of the labels; each sends its children their suffix."""
    n, height = len(levels[0]), len(levels) - 1
    found: list[tuple] = [()] * n
    queue: list[tuple] = [(0, -height, 0, above)]
    while queue:
        _, level, place, suffix = heappop(queue)
        if not level:
            found[place] = suffix
            continue
        below = -level - 1
        run = levels[below][place * FAN:(place + 1) * FAN]
        for i in range(len(run)):
            child = place * FAN + i
            heappush(queue, (-min((child + 1) * FAN**below, n), -below, child, ((i, "".join(run[:i] + run[i + 1:])), *suffix)))
    return found


def written(suffix: tuple) -> str:
    """A suffix as text: ``place:digests`` by level, comma-joined."""
    return ",".join(f"{place}:{others}" for place, others in suffix)


def read(text: str) -> tuple:
    """The suffix that :func:`written` wrote."""
    return tuple((int(place), others) for place, _, others in (level.partition(":") for level in text.split(","))) if text else ()


def folded(digest: str, suffix: tuple) -> str:
    """The root that follows from a leaf and its proof."""
    for place, others in suffix:
        digest = sha256(f"{others[:64 * place]}{digest}{others[64 * place:]}".encode()).hexdigest()
    return digest


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``ordinal`` (from 0, in ``order`` within ``kin``) and ``n`` (rows of ``kin``). Rows are range-partitioned and
    numbered as they stream by; only one count for each (partition, kin) is summed up."""
    ranged = rows.repartitionByRange("kin", *order).sortWithinPartitions("kin", *order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kin, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            kins = batch.column("kin").to_pylist()
            numbers = np.empty(len(kins), dtype=np.int64)
            for i, k in enumerate(kins):
                kin, at = k, at + 1 if k == kin else 0
                numbers[i] = at
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(kins), pa.int32()), pa.array(numbers)], names=[*batch.schema.names, "part", "inside"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema), "part int", "inside long"])
    stored = shared_table(ranged.mapInArrow(count, schema), "ordered")
    sums = stored.groupBy("kin", "part").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("kin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("kin", "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy("kin")).alias("n"))
    met = stored.join(small_side(shared_table(sums, "offsets")), ["kin", "part"])
    return shared_table(met.withColumn("ordinal", F.col("inside") + F.col("before")).drop("part", "inside", "before"), "leaves")


def whole(table: pa.Table) -> tuple[pa.Table, list[list[str]]]:
    """The members of a slice in order, and the digests of its nodes by level."""
    table = table.sort_by("ordinal")
    return table, forward(table.column("digest").to_pylist(), height_of(table.column("n")[0].as_py(), table.num_rows))


def sliced(nodes: DataFrame) -> DataFrame:
    """Nodes with the number of their slice."""
    return nodes.withColumn("slice", F.floor(F.col("ordinal") / SLICE))


NODES = "kin string, ordinal long, n long, digest string"
ABOVE = "kin string, slice long, above string, subroot string, root string"


def climb(leaves: DataFrame) -> list[DataFrame]:
    """Rounds of nodes (kin, ordinal, n, digest), each the tops of the slices of the one before, until every kin has one."""
    form = pa.schema([("kin", pa.string()), ("ordinal", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])

    def rise(held: pa.Table) -> pa.Table:
        held, levels = whole(held)
        ordinal, n = held.column("ordinal")[0].as_py() // SLICE, -(-held.column("n")[0].as_py() // SLICE)
        return pa.Table.from_pydict({"kin": [held.column("kin")[0].as_py()], "ordinal": [ordinal], "n": [n], "digest": [levels[-1][0]]}, schema=form)

    rounds = [leaves]
    while not rounds[-1].where("n > 1").isEmpty():
        nodes = sliced(rounds[-1].select("kin", "ordinal", "n", "digest"))
        rounds.append(shared_table(nodes.groupBy("kin", "slice").applyInArrow(rise, NODES), "nodes"))
    return rounds


def descend(rounds: list[DataFrame], above: DataFrame, leaf, schema: str) -> DataFrame:
    """Messages ``above`` of the tops brought down round by round; ``leaf`` makes the result's columns of one slice of
    the first round from its members, their suffixes and the message."""
    form = pa.schema([("kin", pa.string()), ("slice", pa.int64()), ("above", pa.string()), ("subroot", pa.string()), ("root", pa.string())])

    def lower(make):
        def run(held: pa.Table, message: pa.Table) -> pa.Table:
            if not held.num_rows or not message.num_rows:
                raise ValueError("a slice and its message do not meet")
            held, levels = whole(held)
            return make(held, backward(levels, read(message.column("above")[0].as_py())), {c: message.column(c)[0].as_py() for c in ("subroot", "root")})

        return run

    def passed(held: pa.Table, suffixes: list[tuple], message: dict) -> pa.Table:
        return pa.Table.from_arrays([held.column("kin"), held.column("ordinal"), pa.array(map(written, suffixes), pa.string()),
                                     *[pa.array([message[c]] * held.num_rows, pa.string()) for c in ("subroot", "root")]], schema=form)

    for level in range(len(rounds) - 2, -1, -1):
        make, out = (leaf, schema) if level == 0 else (passed, ABOVE)
        nodes = sliced(rounds[level])
        above = nodes.groupBy("kin", "slice").cogroup(above.groupBy("kin", "slice")).applyInArrow(lower(make), out)
        above = above if level == 0 else shared_table(above, "above")
    return above


def manifest(documents: DataFrame, presented: Column | None = None, fields: Sequence[str] = FIELDS, identity: str = "doc_id", group: str = "lang",
             text: str = "text", proofs: bool = False) -> DataFrame:
    """One row per document row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified (and ``proof``).

    ``presented`` is the text whose proof is checked (the stored one by default): ``folded_root`` follows from the
    leaf with that text and the stored siblings, ``verified`` tells whether it is the root. ``proof`` lists
    ``place:digests`` from the leaf up, comma-joined. Leaves ascend by identity (null first), then by leaf; rows that
    are wholly equal are leaves of their own. Groups ascend bytewise, null first. A lone leaf is its subroot and a lone
    subroot the root, with the digest of nothing as ``proof_sha256`` if both hold. Nulls are hashed as such; an empty
    table gives no rows; columns outside ``fields`` are not read.

    The texts are read once and never shuffled. A task holds a slice of SLICE digests; a group of any size is cut
    into such slices, in as many rounds as its number of leaves has digits to the base SLICE.
    """
    values = {c: F.col(f"`{c}`") for c in fields}
    shown = leaf_digest([values[c] if c != text or presented is None else presented for c in fields])
    kin = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    rows = documents.select(F.col(f"`{identity}`").cast("long").alias("doc_id"), kin.alias("kin"), leaf_digest(list(values.values())).alias("digest"), shown.alias("shown"),
                            F.monotonically_increasing_id().alias("row"))
    rows = shared_table(rows, "rows")
    rounds = climb(numbered(rows, ["doc_id", "digest", "row"]).drop("row"))
    if len(rounds) == 1:  # no group has two leaves: the leaves are their own tops
        rounds.append(rounds[0].select("kin", "ordinal", "n", "digest"))
    tops = rounds[-1].select(F.lit("").alias("kin"), F.col("kin").alias("of"), "digest")
    roots = climb(numbered(tops, ["of"]))
    if len(roots) == 1:
        roots.append(roots[0].select("kin", "ordinal", "n", "digest"))

    def subroots(held: pa.Table, suffixes: list[tuple], message: dict) -> pa.Table:
        return pa.Table.from_arrays([held.column("of"), pa.array([0] * held.num_rows, pa.int64()), pa.array(map(written, suffixes), pa.string()), held.column("digest"),
                                     pa.array([message["root"]] * held.num_rows, pa.string())], names=["kin", "slice", "above", "subroot", "root"])

    top = roots[-1].select("kin", F.col("ordinal").alias("slice"), F.lit("").alias("above"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    above = shared_table(descend(roots, top, subroots, ABOVE), "above")

    def leaves(held: pa.Table, suffixes: list[tuple], message: dict) -> pa.Table:
        n, root = held.num_rows, message["root"]
        ends = [folded(s, suffix) for s, suffix in zip(held.column("shown").to_pylist(), suffixes)]
        columns = {"doc_id": held.column("doc_id"), "leaf": held.column("digest"), "subroot": pa.array([message["subroot"]] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
                   "proof_sha256": pa.array([sha256("".join(o for _, o in s).encode()).hexdigest() for s in suffixes], pa.string()), "folded_root": pa.array(ends, pa.string()),
                   "verified": pa.array([e == root for e in ends], pa.bool_())}
        if proofs:
            columns["proof"] = pa.array(map(written, suffixes), pa.string())
        return pa.Table.from_pydict(columns)

    form = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return descend(rounds, above, leaves, form + (", proof string" if proofs else ""))
