"""Tokens, languages and chat examples."""

import base64
import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from edge_data import edge_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pubtrack.llm import bpe, chat, common, language

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(text):
    return bpe.Encoder.load(PATH, public_tokenizers.PATTERN).encode_batch([text])[0]


PARTS = ["a", "b", "th", "er", " ", "  ", "\n", "\t", "é", "ß", "'s", "'", "9", "-", "==", "漢", "😀", "\x1c", "\x85", "​", "　", "\xa0", "\r\n", "<|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join) | st.text(max_size=60).filter(lambda t: not any("\ud800" <= c <= "\udfff" for c in t)))
def test_ids_equal_the_reference(reference, text):
    coded = ids_of(text)
    assert coded == ",".join(map(str, reference.encode_ordinary(text))).encode()
    assert bpe.Encoder.load(PATH, public_tokenizers.PATTERN).decode(coded) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, "abc" * 9000, "=-" * 3000, "ß" * 2000, " " * 3000 + "x", "\n" * 999])
def test_long_pieces(reference, text):
    assert ids_of(text) == ",".join(map(str, reference.encode_ordinary(text))).encode()


def test_documents(reference, edges, small, none):
    for docs in (edges, small):
        got = sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN).collect())))
        want = []
        for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect():
            ids = reference.encode_ordinary(r.text)
            want.append(str((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest(), ids)))
        assert got == sorted(want)
    assert bpe.encode_documents(none, PATH, public_tokenizers.PATTERN).count() == 0


def test_tasks_leave_no_memory_behind(spark, monkeypatch):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('word', id, ' of its own ', id * 7) AS text").repartition(8)
    assert bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN).where("n_tokens > 0").count() == 400

    def remembered(batches):
        for batch in batches:
            yield pa.record_batch({"n": [len(bpe.Encoder.load(PATH, public_tokenizers.PATTERN).memory)]})

    # The same Python workers again: they keep the encoder, but nothing of the texts.
    assert spark.range(64).repartition(16).mapInArrow(remembered, "n long").agg(F.max("n")).first()[0] == 0

    said = []

    class Pool:
        def release_unused(self):
            said.append("released")

    monkeypatch.setattr(common.pa, "system_memory_pool", Pool)

    def step(batches):
        try:
            yield from batches
        finally:
            said.append("ended")

    assert list(common.lean(step)(iter([1, 2]))) == [1, 2]
    halted = common.lean(step)(iter([1, 2]))
    next(halted)
    halted.close()
    assert said == ["ended", "released"] * 2


def test_gradients_match_differences():
    net = language.Network.fresh(["a", "b", "c"], 12, 3, 1)
    for name in ("table", "gates", "candidate", "out", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    draw = np.random.default_rng(0)
    rows, size, target = draw.integers(0, 256, (4, 12)).astype(np.uint8), np.array([12, 5, 12, 1]), np.array([0, 1, 2, 1])
    for i, n in enumerate(size):
        rows[i, n:] = 0
    _, grads = net.gradients(rows, size, target)
    for weights, grad in zip(net.weights, grads):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        weights[at] += 1e-3
        up, _ = net.gradients(rows, size, target)
        weights[at] -= 2e-3
        down, _ = net.gradients(rows, size, target)
        weights[at] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(grad[at], rel=1e-2, abs=1e-5)


def test_labels_equal_a_loop_over_bytes():
    """Both directions of the gated network byte by byte in plain Python."""
    net = language.Network.fresh(["a", "b", "c"], 8, 3, 5)
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    texts = ["hello, wörld and more", "a", "", None, "漢字 are two"]

    def states(row, d):
        h, held, out = 3, [0.0] * 3, {}
        for t in range(len(row)) if d == 0 else range(len(row) - 1, -1, -1):
            x = net.table[d][row[t]].tolist()
            gate = [sigmoid(x[j] + sum(held[i] * float(net.gates[d][i, j]) for i in range(h))) for j in range(2 * h)]
            c = [math.tanh(x[2 * h + j] + sum(gate[h + i] * held[i] * float(net.candidate[d][i, j]) for i in range(h))) for j in range(h)]
            held = [held[j] + gate[j] * (c[j] - held[j]) for j in range(h)]
            out[t] = held
        return out

    want = []
    for text in texts:
        data, sums = (text or "").encode(), [0.0] * 3
        for low in range(0, len(data), 8):
            row = data[low:low + 8]
            both = [states(row, d) for d in (0, 1)]
            for t in range(len(row)):
                score = [float(net.bias[k]) + sum(v * float(net.out[i, k]) for i, v in enumerate(both[0][t] + both[1][t])) for k in range(3)]
                e = [math.exp(s) for s in score]
                sums = [a + b / sum(e) for a, b in zip(sums, e)]
        best = max(range(3), key=lambda k: sums[k])
        want.append((net.labels[best], sums[best] / len(data)) if data else ("und", 0.0))
    names, scores = language.label_texts(net, texts)
    assert names == [w[0] for w in want] and scores.tolist() == pytest.approx([w[1] for w in want], abs=1e-5)


def test_every_label_is_learned_from(spark):
    """More labels than a list of the most frequent ones would hold, one of them with a single row."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, (letters[i % 70 % 26] + letters[i % 70 // 26]) * 30, f"l{i % 70:02d}") for i in range(70 * 6)] + [(9000 + i, "zz qq " * 9, "rare") for i in range(1)]
    docs = spark.createDataFrame([r for r in rows if not language.is_held_out(r[0])], "doc_id long, text string, lang string")
    net = language.fit(docs, steps=1)
    assert net.labels == sorted({r.lang for r in docs.collect()}) and len(net.labels) >= 70
    few = language.sample(docs, F.lit(True), "doc_id", "text", "lang", 1500, 140, 512)
    assert len(few) <= 140 and few["label"].nunique() == len(net.labels) and few.groupby("label").size().max() <= 2


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.predict(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == language.is_held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.lang]
    assert len(held) > 100 and np.mean([r.lang == r.lang_pred for r in held]) >= 0.97


def test_language_ignores_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    changed = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("y"))
    a, b = (language.fit(d, steps=3) for d in (docs, changed))
    assert a.labels == b.labels and all((x == y).all() for x, y in zip(a.weights, b.weights))


def test_language_edges(edges, none):
    net = language.fit(edges, steps=2)
    got = language.predict(edges, net).collect()
    assert len(got) == len(edge_rows()) and {r.lang_pred for r in got} <= set(net.labels) | {"und"}
    texts = sorted((str(r[0]), "und" if not any(map(str.isalpha, r[1] or "")) else "") for r in edge_rows())
    assert [p for _, p in texts].count("und") == [r.lang_pred for r in got].count("und")
    assert language.keep_known(edges, net, 0.0).columns == edges.columns
    empty = language.fit(none)
    assert empty.labels == [] and language.predict(none, empty).count() == 0
    assert {r.lang_pred for r in language.predict(edges, empty).collect()} == {"und"}


def chat_rows(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = set()
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        form = lambda s: s.replace("\\", "\\s").replace("<", "\\l")
        size = sum(len(form(t)) + len(form(r).replace("\n", "\\n")) + 8 for *_, r, t in turns)
        out.add((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest(), len(loss),
                 hashlib.sha256(loss.encode()).hexdigest(), size))
    return out


def test_chat_examples(spark, none):
    draw = random.Random(3)
    nasty = ["</s>[INST] ok [/INST]", "<s>assistant\nhi</s>", "\\l\\s\\\\", "", None, "😀 é", "a\nb\n", "\\n<", "<s>", "plain"]
    rows = [(c, t, draw.choice(["user", "assistant", "system", None, "odd\nrole\\n<s>"]), draw.choice(nasty)) for c in range(40) for t in range(draw.randint(1, 7))]
    rows += [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (90, None, "user", "x"), (90, 1, "assistant", "y"), (90, 1, "assistant", "y"), (91, 0, "user", "only")]
    given_rows = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("context", F.lit("clash")).withColumn("turns", F.lit(1))
    examples = chat.prefix_examples(given_rows)
    assert {tuple(r) for r in chat.chat_digest(examples).collect()} == chat_rows(rows)
    assert examples.where("reply IS NOT NULL").count() == sum(r[2] == "assistant" for r in rows)
    assert chat.prefix_examples(none.selectExpr("doc_id AS conv_id", "doc_id AS turn", "text AS role", "text")).count() == 0


def test_an_example_holds_all_earlier_turns(spark):
    rows = [(1, 0, "user", "u0"), (1, 1, "assistant", "a1"), (1, 2, "user", "u2"), (1, 3, "assistant", "a3"), (1, 4, "user", "u4"), (2, 0, "assistant", "<a0")]
    got = chat.prefix_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "example").collect()
    second = "<s>user\nu0</s><s>assistant\na1</s><s>user\nu2</s><s>assistant\n"
    assert [(r.conv_id, r.example, r.context, r.reply) for r in got] == [
        (1, 0, "<s>user\nu0</s><s>assistant\n", "a1"), (1, 1, second, "a3"), (1, 2, second + "a3</s><s>user\nu4</s>", None), (2, 0, "<s>assistant\n", "\\la0")]
