"""Shards, manifest and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
from edge_data import WORDS
from pyspark.sql import functions as F

from check import rows_of
from pubtrack.llm import merkle, queries, shards, spelling


def test_queries_match_their_sql(spark):
    db = duckdb.connect()
    db.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    for name in ("op11_random_shards", "op12_merkle_manifest", "op13_spelling_variants"):
        got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        cursor = db.execute(queries.ORACLES[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(got.columns)
        assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, cursor.fetchall()), name


def laid(docs, path, count, **more):
    """The rows of the shards by shard, checked for even counts and slots without gaps."""
    rows = shards.write_shards(docs, str(path), count, **more).collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.shard, r.slot)):
        by[r.shard].append(r)
    sizes = [len(by.get(s, [])) for s in range(count)]
    assert set(by) <= set(range(count)) and (not rows or max(sizes) - min(sizes) <= 1)
    assert all([r.slot for r in held] == list(range(len(held))) for held in by.values())
    return [r.record for s in sorted(by) for r in by[s]]


def test_shards_hold_every_row(edges, none, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "BUCKET_ROWS", 4)
    extra = edges.withColumns({"shard": F.lit(1), "slot": F.lit(2), "bucket": F.lit("b"), "record": F.lit("r"), "sub": F.lit(None).cast("int"), "pairs": F.create_map(F.lit("a"), F.lit(1))})
    # One row for a third of the table, and one identity with different texts.
    rows = extra.unionByName(extra.where("doc_id = 9").withColumn("text", F.explode(F.array_repeat(F.col("text"), 60)))).unionByName(
        extra.where("doc_id = 10").withColumn("text", F.explode(F.transform(F.sequence(F.lit(1), F.lit(90)), lambda i: F.concat(F.lit("t"), i.cast("string"))))))
    got = laid(rows, tmp_path / "a", 7)
    assert Counter(map(str, got)) == Counter(map(str, rows.collect())) and [r for r in got] != rows.collect()
    assert laid(none, tmp_path / "b", 3) == [] and len(laid(edges, tmp_path / "c", 40)) == edges.count()


def test_shards_are_a_seeded_fisher_yates(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "BUCKET_ROWS", 25)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))

    def draw(*parts):
        return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:12], 16)

    buckets, order = defaultdict(list), []
    for i in range(300):
        buckets[draw("s", i) % 12].append(i)
    for bucket in sorted(buckets):
        held = []
        for i, x in enumerate(buckets[bucket]):
            j = draw("s", bucket, 0, i) % (i + 1)
            held.append(x)
            held[i], held[j] = held[j], x
        order += held
    assert [r.doc_id for r in laid(docs, tmp_path / "a", 7, seed="s")] == order
    assert [r.doc_id for r in laid(docs.repartition(3), tmp_path / "b", 7, seed="s")] == order
    assert [r.doc_id for r in laid(docs, tmp_path / "c", 7, seed="t")] != order


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    """Root of a list of digests and the proof of each: per level its place and the whole run."""
    proofs, place, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for i, p in enumerate(place):
            proofs[i].append((p % 8, nodes[p // 8 * 8:p // 8 * 8 + 8]))
            place[i] = p // 8
        nodes = [digest("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], proofs


def manifest_rows(rows, changed):
    groups = defaultdict(list)
    for r in rows:
        def leaf(text):
            return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))

        groups[r.lang].append((r.doc_id is not None, r.doc_id, leaf(r.text), leaf(changed(r))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in order}
    if not order:
        return Counter()
    root, tops = tree([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops):
        for (_, doc_id, leaf, shown), proof in zip(sorted(groups[g]), trees[g][1]):
            at, beside = shown, ""
            for place, run in proof + top:
                beside += "".join(run[:place] + run[place + 1:])
                at = digest("".join(run[:place]) + at + "".join(run[place + 1:]))
            out.append((doc_id, leaf, trees[g][0], root, digest(beside), at, at == root))
    return Counter(out)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest(edges, none, spark):
    edges = edges.withColumn("n_chars", F.length("text")).withColumns({n: F.lit("clash") for n in ("kin", "ordinal", "slice", "n", "digest", "leaf", "root", "shown")})
    large = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") % 9 > 1, "en").when(F.col("id") == 9, "solo").alias("lang"),
                                     F.lit(None).cast("int").alias("n_chars"), F.concat(F.lit("Text "), "id").alias("text"))
    changed = F.when(F.col("doc_id") % 3 == 0, F.lower("text")).otherwise(F.col("text"))
    for docs in (edges, large, large.limit(1), none.withColumn("n_chars", F.lit(1))):
        got = merkle.manifest(docs, changed)
        assert Counter(tuple(r) for r in got.select(COLUMNS).collect()) == manifest_rows(docs.collect(), lambda r: r.text.lower() if r.text and r.doc_id is not None and r.doc_id % 3 == 0 else r.text)
    row = merkle.manifest(large, proofs=True).where("doc_id = 4321").first()
    assert row.verified and merkle.folded(row.leaf, merkle.read(row.proof)) == row.root


def test_sweeps_agree_with_levels():
    for n in (1, 2, 7, 8, 9, 64, 65, 513, 4096):
        leaves = [digest(str(i)) for i in range(n)]
        levels = merkle.forward(leaves, merkle.height_of(n, n))
        root, proofs = tree(leaves)
        assert levels[-1] == [root]
        found = merkle.backward(levels, ((0, "above"),))
        assert [list(s) for s in found] == [[(p, "".join(r[:p] + r[p + 1:])) for p, r in proof] + [(0, "above")] for proof in proofs]


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def spelling_rows(rows, every):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % every else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_apart(v, w)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        end = w
        while form[end]:
            end = form[end]
        out.append((w, form[w], end, words[w], len(near[w]), words.get(form[w])))
    return Counter(out)


def test_spelling_groups(edges, none, spark):
    draw = random.Random(4)
    rows = []
    for i in range(200):
        words = [draw.choice(WORDS[:12]) for _ in range(40)]
        for at in range(0, 40, 3):
            w = words[at]
            p = draw.randrange(len(w))
            words[at] = draw.choice([w[:p] + w[p + 1:], w[:p] + draw.choice("abÉéß") + w[p:], w[:p] + draw.choice("xyà÷") + w[p + 1:], w.upper()])
        rows.append((None if i % 17 == 0 else i, " ".join(words)))
    rows += rows[:3] + [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("clash") for n in ("word", "n", "signature", "form", "root", "best")})
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    for held in (docs, edges):
        got = Counter(tuple(r) for r in spelling.spelling_groups(held, damage_every=5).select(columns).collect())
        assert got == spelling_rows([(r.doc_id, r.text) for r in held.collect()], 5)
    assert any(r[1] and r[1] != r[2] for r in spelling_rows(rows, 5)) and spelling.spelling_groups(none).count() == 0


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 10)
    for text in ("", "alphabet", "alphabetical order, of the words. " * 9, "x" * 50, "  \n" * 20, "é" * 25 + " end"):
        assert "".join(spelling.pieces(text)) == text
        assert Counter(w for p in spelling.pieces(text) for w in spelling.RUN.findall(p)) == Counter(spelling.RUN.findall(text))


def test_signatures_survive_two_changes():
    words = ["kappa", "kapa", "kappas", "kippa", "omicron", "omikron"]
    batch = pa.RecordBatch.from_pydict({"word": words, "n": [1] * 6})
    found = defaultdict(set)
    for b in spelling.signatures(iter([batch])):
        for r in b.to_pylist():
            found[r["word"]].add((r["signature"], r["longer"]))
    for a in words:
        for b in words:
            if one_apart(a, b):
                assert any(s == t and not (x and y) for s, x in found[a] for t, y in found[b])
