"""Exact and near duplicates and repeated passages against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from edge_data import edge_rows, prose

from pubtrack.llm import common, exact, near, passages
from pubtrack.llm.common import components
from pubtrack.llm.shingles import words_of

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def plain(docs):
    return [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]


def exact_rows(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text.translate(LOW)].append(doc_id)
    out = []
    for form, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        done = False
        for i in ids:
            kept = i == keep and not done
            done |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(form).hexdigest()))
    return Counter(out)


def test_exact_groups(edges, small, none):
    for docs in (edges, small):
        got = exact.exact_groups(docs)
        assert Counter(tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == exact_rows(plain(docs))
    assert exact.exact_groups(none).count() == 0


def of_rows(docs):
    return Counter((r.doc_id, r.text) for r in docs.collect())


def test_kept_rows_of_exact_groups(clashing, none):
    kept = exact.keep_distinct(clashing)
    assert kept.columns == clashing.columns and exact.keep_distinct(none).columns == none.columns and exact.keep_distinct(none).count() == 0
    rows = kept.collect()
    groups = defaultdict(set)
    for r in clashing.collect():
        groups[(r.text or "").encode().translate(LOW)].add((r.doc_id, r.text))
    found = defaultdict(list)
    for r in rows:
        found[(r.text or "").encode().translate(LOW)].append((r.doc_id, r.text))
    assert set(found) == set(groups)
    for form, mine in found.items():
        best = max((i for i, _ in groups[form] if i is not None), default=None)
        assert len(mine) == 1 and mine[0] in groups[form] and mine[0][0] == best


def test_representatives_of_near_groups(spark, clashing, none):
    kept = near.keep_representatives(clashing)
    assert kept.columns == clashing.columns and near.keep_representatives(none).count() == 0 and near.keep_representatives(none).columns == none.columns
    wordless = Counter({k: n for k, n in of_rows(clashing).items() if not (k[1] or "").strip(" \t\n\x0b\x0c\r")})
    got = of_rows(kept)
    assert {k: got[k] for k in wordless} == dict(wordless)
    worded = clashing.where("text IS NOT NULL").select("doc_id", "text").distinct()
    want = Counter(i for i, n, _, k in near_rows_of(plain(worded)) if n and k)
    assert Counter(i for (i, t), n in got.items() if (i, t) not in wordless for _ in range(n)) == want
    # Rows of one identity: the copy of another document's text goes, the other text stays.
    t, u = prose(50, 30), prose(51, 30)
    docs = spark.createDataFrame([(0, t), (1, t), (1, u), (1, u), (2, u + " end")], "doc_id long, text string")
    assert of_rows(near.keep_representatives(docs)) == Counter([(0, t), (1, u)])


def near_rows_of(rows):
    """Rows of near_rows with one kept row per group."""
    seen, out = set(), []
    for row in sorted(near_rows(rows).elements(), key=lambda r: (r[0] is None, r[0] or 0)):
        out.append(row if not (row[3] and row[1] and (row[2], row[1]) in seen) else (*row[:3], False))
        seen.add((row[2], row[1]))
    return out


def test_directory_splits_only_overfull_buckets():
    grown = exact.Directory.grow({0: 5, 1: 5, 2: 90, 3: 90, 9: 1}, 4, 100, 3)
    # Slots 2 and 3 need all four bits; their neighbours and the upper half share buckets of several entries.
    assert grown.bits == 4 and len(set(grown.bucket[2:4])) == 2
    assert grown.bucket[0] == grown.bucket[1] and len(set(grown.bucket[8:])) == 1 and len(set(grown.bucket)) == 5
    assert list(grown.owner) == sorted(grown.owner)
    assert exact.Directory.grow({}, 4, 100, 3).bits == 0


def test_colliding_keys_are_chained_and_compared(monkeypatch, spark):
    monkeypatch.setattr(exact, "key_of", lambda form: 7)
    import pyarrow as pa
    rows = pa.RecordBatch.from_pydict({"owner": [0] * 4, "bucket": [0] * 4, "key": [7] * 4, "form": [b"a", b"b", b"a", b"c"], "keep_id": [1, 2, 3, None], "n": [1, 1, 2, 1]})
    found = [row for batch in exact.build(iter([rows])) for row in batch.to_pylist()]
    assert {(r["sha"], r["keep_id"], r["group_size"]) for r in found} == {
        (hashlib.sha256(t).hexdigest(), i, n) for t, i, n in ((b"a", 3, 3), (b"b", 2, 1), (b"c", None, 1))}


def near_rows(rows):
    sets = []
    for _, text in rows:
        w = text.translate(LOW).split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common = len(a & b)
            if a and b and 100 * common >= 75 * (len(a) + len(b) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), doc_id) if x is not None), default=None)
    return Counter((d, len(s), least[find(i)] if s else d, d == (least[find(i)] if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def test_near_components(edges, small, none):
    for docs in (edges, small):
        got = near.near_components(docs).select("doc_id", "n_shingles", "component_id", "kept")
        assert Counter(tuple(r) for r in got.collect()) == near_rows(plain(docs))
    assert near.near_components(none).count() == 0


# Nodes settled at once, named by members, cut into blocks, and branched first.
@pytest.mark.parametrize("patched", [{}, {"NAMED": 0}, {"DENSE_NODE": 6}, {"DENSE_NODE": 6, "NAMED": 0, "BLOCK": 5}])
def test_large_nodes_are_branched_and_settled(spark, monkeypatch, patched):
    monkeypatch.setattr(near, "SMALL_NODE", 3)
    for name, value in patched.items():
        monkeypatch.setattr(near, name, value)
    # A chain of near copies, unrelated texts with a common passage, and copies of one text.
    words = prose(7, 120).split()
    rows = [(i, " ".join(words[:i] + [f"x{i}"] + words[i + 1:])) for i in range(0, 60, 3)]
    common = prose(8, 40)
    rows += [(100 + i, common + " " + prose(100 + i, 90)) for i in range(25)]
    rows += [(200 + i, prose(9, 30)) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near.near_components(docs).select("doc_id", "n_shingles", "component_id", "kept")
    assert Counter(tuple(r) for r in got.collect()) == near_rows(plain(docs))


def test_recall_does_not_fall_with_depth(spark, monkeypatch):
    for name in ("SMALL_NODE", "DENSE_NODE"):
        monkeypatch.setattr(near, name, 3)
    monkeypatch.setattr(near, "TREES", 3)  # few trees, so that a loss shows
    # Texts of passages that many others share; every second one repeats the one before but for one passage.
    draw = random.Random(6)
    pool = [prose(500 + i, 16) for i in range(40)]
    rows = []
    for i in range(0, 600, 2):
        chosen = draw.sample(pool, 8)
        rows += [(i, " ".join(chosen)), (i + 1, " ".join(chosen[:7] + [prose(2000 + i, 16)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near.near_components(docs).select("doc_id", "n_shingles", "component_id", "kept")
    assert Counter(tuple(r) for r in got.collect()) == near_rows(plain(docs))


def test_miss_is_bounded_at_every_level():
    # Two children a node: a level has at most as many rows as the one above, and a loss has this limit.
    assert all(near.miss(level) < 6e-5 for level in (*range(1, 31), 1000)) and near.miss(3) < 2e-7


@pytest.mark.parametrize("task_edges", [1_000_000, 40])
def test_components_of_a_chain(spark, monkeypatch, task_edges):
    monkeypatch.setattr(common, "TASK_EDGES", task_edges)
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 90), (95, 100)], "a long, b long")
    assert {r.id: r.component for r in components(links).collect()} == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


def passage_rows(rows, length=50):
    first = {}
    for doc_id, text in rows:
        if doc_id is not None:
            w = text.split()
            for i in range(len(w) - length + 1):
                k = tuple(w[i:i + length])
                first[k] = min(first.get(k, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        w = text.split()
        gone = np.zeros(len(w), dtype=bool)
        for i in range(len(w) - length + 1):
            if doc_id is not None and first[tuple(w[i:i + length])] < doc_id:
                gone[i:i + length] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc_id, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_repeated_passages(edges, small, none):
    for docs in (edges, small):
        assert Counter(tuple(r) for r in passages.remove_repeats(docs).collect()) == passage_rows(plain(docs))
    assert passages.remove_repeats(none).count() == 0


def test_passages_at_every_alignment(spark):
    shared = prose(11, 50)
    rows = [(i, prose(300 + i, i % 37) + " " + shared + " " + prose(400 + i, 5)) for i in range(40)]
    rows += [(50, prose(12, 49)), (51, prose(12, 49)), (52, "a " * 200), (53, "b " + "a " * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert Counter(tuple(r) for r in passages.remove_repeats(docs).collect()) == passage_rows(plain(docs))


def test_cover_reaches_every_pair_of_offsets():
    cover = set(passages.COVER)
    for i in range(passages.PERIOD):
        for j in range(passages.PERIOD):
            assert any((i + s) % passages.PERIOD in cover and (j + s) % passages.PERIOD in cover for s in range(passages.PERIOD))


def test_word_hashes_do_not_depend_on_neighbours():
    texts = [b"one  two\tthree", b"", "é two \n".encode(), b"THREE one"]
    words = words_of(texts, lower=True)
    assert np.diff(words.first).tolist() == [3, 0, 2, 2]
    assert words.hashes[1] == words.hashes[4] and words.hashes[0] == words.hashes[6] and words.hashes[2] == words.hashes[5]
    assert len(set(words.hashes.tolist())) == 4


def test_dense_groups_are_compared_in_full(spark, monkeypatch):
    monkeypatch.setattr(near, "SMALL_NODE", 4)
    monkeypatch.setattr(near, "BLOCK", 16)
    draw = random.Random(5)
    base = prose(21, 70).split()
    rows = []
    for i in range(90):  # copies with so many edits that some are linked and others only similar
        words = list(base)
        for _ in range(draw.randint(0, 5)):
            words[draw.randrange(len(words))] = f"e{draw.randint(0, 30)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near.near_components(docs).select("doc_id", "n_shingles", "component_id", "kept")
    want = near_rows(plain(docs))
    assert Counter(tuple(r) for r in got.collect()) == want and len({k[2] for k in want}) > 10


def test_common_counts():
    draw = np.random.default_rng(2)
    sets = [np.unique(draw.integers(0, 60, draw.integers(0, 40)).astype(np.uint64)) for _ in range(45)] + [np.empty(0, dtype=np.uint64)]
    sets += [np.unique(draw.integers(1000, 1400, 30).astype(np.uint64)) for _ in range(20)]
    counts = near.common_counts(sets)
    assert all(counts[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)
