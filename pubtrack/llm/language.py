"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled rows. A
text is cut into rows of ``width`` bytes, each read in both directions; every byte gets a probability
for every language, and a document takes the mean of its bytes' probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pubtrack.llm.common import lean, shared_table, slices
from pubtrack.session import small_side

#: Rows of bytes that go through the network side by side.
TOGETHER = 2048
UNKNOWN = "und"


def sample(documents: DataFrame, usable: Column, identity: str, text: str, label: str, rows_per_label: int, most_rows: int, chars: int) -> pd.DataFrame:
    """A bounded sample (label, text) over all labels: ``rows_per_label`` rows of each, or fewer if the labels together
    would give more than ``most_rows``. Beyond ``most_rows`` labels only that many rows, hence labels, are drawn.

    The rows are those with the least hashes of identity and text: a first aggregate counts the labels,
    and only rows below the hash bound that a label's count implies are sorted, so no label is gathered.
    From each row ``chars`` characters at a place that its hash chooses are read.
    """
    given = documents.where(usable).select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"),
                                           F.xxhash64(F.col(identity).cast("string"), F.col(text)).alias("hash")).where("label IS NOT NULL AND text IS NOT NULL")
    given = given.where(F.col("text").rlike(r"\p{L}"))
    counts = shared_table(given.groupBy("label").agg(F.count(F.lit(1)).alias("rows")), "labels")
    labels = counts.count()
    if not labels:
        return pd.DataFrame({"label": [], "text": []})
    per = max(1, min(rows_per_label, most_rows // labels))
    drawn = per + 4 * per**0.5 + 8  # expected rows of a label below its bound: fewer than ``per`` are very rare
    unit = (F.col("hash") / F.lit(2.0**64)) + 0.5
    few = given.join(small_side(counts), "label").where(unit < F.least(F.lit(1.0), F.lit(drawn) / F.col("rows")))
    start = (F.pmod(F.col("hash"), F.greatest(F.length("text") - chars, F.lit(0)) + 1) + 1).cast("int")
    few = few.select("label", F.substring("text", start, F.lit(chars)).alias("text"), "hash")
    first = few.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("hash", "text"))).where(F.col("place") <= per)
    found = first.orderBy("hash", "label", "text").limit(most_rows).toPandas()
    return found[["label", "text"]]


def byte_rows(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts as rows of ``width`` (padded with 0), the length of every row and its text."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    rows = -(-lengths // width)
    owner = np.repeat(np.arange(len(texts)), rows)
    flat = np.zeros(int(rows.sum()) * width, dtype=np.uint8)
    for start, text in zip((np.cumsum(rows) - rows) * width, texts):
        flat[start:start + len(text)] = np.frombuffer(text, dtype=np.uint8)
    last = np.cumsum(rows)[rows > 0] - 1
    size = np.full(len(owner), width)
    size[last] = (lengths - (rows - 1) * width)[rows > 0]
    return flat.reshape(-1, width), size, owner


@dataclass
class Network:
    """Weights of both directions (index 0: left to right) and of the output layer.

    ``table[d][byte]`` is the input's contribution to the update gate, the reset gate and the candidate;
    gates are computed as tanh of half their argument.
    """

    labels: list[str]
    width: int
    table: np.ndarray
    gates: np.ndarray
    candidate: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], width: int, hidden: int, seed: int) -> Network:
        draw = np.random.default_rng(seed)
        normal = lambda *shape, scale: (draw.standard_normal(shape) * scale).astype(np.float32)
        table = normal(2, 256, 3 * hidden, scale=0.3)
        table[:, :, :hidden] -= 1.0  # remember at first
        return cls(labels, width, table, normal(2, hidden, 2 * hidden, scale=hidden**-0.5), normal(2, hidden, hidden, scale=hidden**-0.5),
                   normal(2 * hidden, len(labels), scale=0.3), np.zeros(len(labels), dtype=np.float32))

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.table, self.gates, self.candidate, self.out, self.bias]

    def run(self, rows: np.ndarray, size: np.ndarray, d: int, trace: list | None = None) -> np.ndarray:
        """States ``[width, rows, hidden]`` of direction ``d``. Right to left, padding leaves the state at zero."""
        n, width = rows.shape
        h = self.candidate.shape[1]
        state = np.zeros((n, h), dtype=np.float32)
        states = np.empty((width, n, h), dtype=np.float32)
        table, gates, candidate = self.table[d] * np.repeat([0.5, 0.5, 1.0], h).astype(np.float32), self.gates[d] * np.float32(0.5), self.candidate[d]
        columns = np.ascontiguousarray(rows.T)
        short = size.min() < width
        for t in range(width) if d == 0 else range(width - 1, -1, -1):
            x = table.take(columns[t], axis=0)
            g = state @ gates
            g += x[:, :2 * h]
            np.tanh(g, out=g)
            g *= np.float32(0.5)
            g += np.float32(0.5)
            update, reset = g[:, :h], g[:, h:]
            c = (reset * state) @ candidate
            c += x[:, 2 * h:]
            np.tanh(c, out=c)
            if trace is not None:
                trace.append((t, state, update.copy(), reset.copy(), c))
            state = state + update * (c - state)
            if short and d == 1:
                state *= (t < size)[:, None]
            states[t] = state
        return states

    def probabilities(self, rows: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Sum over the bytes of a row of their probabilities, per language: ``[rows, languages]``."""
        n, width = rows.shape
        h, k = self.candidate.shape[1], len(self.labels)
        score = self.run(rows, size, 0).reshape(-1, h) @ self.out[:h]
        score += self.run(rows, size, 1).reshape(-1, h) @ self.out[h:]
        score += self.bias
        score -= score.max(axis=1, keepdims=True)
        np.exp(score, out=score)
        score /= score.sum(axis=1, keepdims=True)
        score = score.reshape(width, n, k)
        if size.min() < width:
            score *= (np.arange(width)[:, None] < size)[:, :, None]
        return score.sum(axis=0)

    def gradients(self, rows: np.ndarray, size: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over all bytes and its gradient, by backpropagation through time."""
        n, width = rows.shape
        h = self.candidate.shape[1]
        traces = [[], []]
        states = [self.run(rows, size, d, traces[d]) for d in (0, 1)]
        both = np.concatenate(states, axis=2)
        score = both @ self.out + self.bias
        score -= score.max(axis=2, keepdims=True)
        p = np.exp(score)
        p /= p.sum(axis=2, keepdims=True)
        mask = (np.arange(width)[:, None] < size).astype(np.float32)
        total = mask.sum()
        loss = float(-(np.log(p[:, np.arange(n), target] + 1e-12) * mask).sum() / total)
        p[:, np.arange(n), target] -= 1.0
        p *= (mask / total)[:, :, None]
        grads = [np.zeros_like(w) for w in self.weights]
        grads[3] += np.einsum("tnh,tnk->hk", both, p, optimize=True)
        grads[4] += p.sum(axis=(0, 1))
        back = p @ self.out.T
        for d in (0, 1):
            flow = np.zeros((n, h), dtype=np.float32)
            for t, before, update, reset, c in reversed(traces[d]):
                flow = flow + back[t][:, d * h:(d + 1) * h]
                if d == 1:
                    flow *= (t < size)[:, None]
                dc = flow * update * (1 - c * c)
                du = flow * (c - before) * update * (1 - update)
                inner = dc @ self.candidate[d].T
                dr = inner * before * reset * (1 - reset)
                dg = np.concatenate([du, dr], axis=1)
                grads[2][d] += (reset * before).T @ dc
                grads[1][d] += before.T @ dg
                np.add.at(grads[0][d], rows[:, t], np.concatenate([dg, dc], axis=1))
                flow = flow * (1 - update) + inner * reset + dg @ self.gates[d].T
        return loss, grads


def train(texts: list[str], labels: list[str], width: int = 64, hidden: int = 8, steps: int = 400, batch: int = 256, seed: int = 7) -> Network:
    """A network fitted with Adam on rows of ``width`` bytes; every label is drawn equally often."""
    names = sorted(set(labels))
    rows, size, owner = byte_rows([t.encode() for t in texts], width)
    target = np.array([names.index(label) for label in labels])[owner]
    keep = size >= width // 4
    rows, size, target = rows[keep], size[keep], target[keep]
    net = Network.fresh(names, width, hidden, seed)
    by_label = [np.flatnonzero(target == k) for k in range(len(names))]
    by_label = [at for at in by_label if len(at)]
    draw = np.random.default_rng(seed)
    means, squares = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    for step in range(1, steps + 1 if by_label else 1):
        at = np.concatenate([draw.choice(group, max(1, batch // len(by_label))) for group in by_label])
        _, grads = net.gradients(rows[at], size[at], target[at])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * min(1.0, step / 20) * (1 - 0.95 * step / steps)
        for w, g, m, s in zip(net.weights, grads, means, squares):
            g *= min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def held_out(identity: Column) -> Column:
    """True where crc32 of the identity as text leaves 2 modulo 4; false for a null identity."""
    return F.coalesce(F.crc32(identity.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, identity: str = "doc_id", text: str = "text", label: str = "lang", rows_per_label: int = 1500, most_rows: int = 96_000,
        chars: int = 512, **training) -> Network:
    """Train on rows that are not held out and have a label, drawn from all labels. ``most_rows`` x ``chars``
    bounds the sample. Without labelled rows the network knows no language and predicts ``und``."""
    given = sample(documents, ~held_out(F.col(identity)), identity, text, label, rows_per_label, most_rows, chars)
    return train(given["text"].tolist(), given["label"].tolist(), **training)


def label_texts(network: Network, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and mean probability of every text; ``und`` and 0 for null and empty ones."""
    coded = [(t or "").encode() for t in texts]
    sums = np.zeros((len(coded), max(1, len(network.labels))))
    for at, n in cuts(coded, TOGETHER * network.width * 4):
        cells, size, owner = byte_rows(coded[at:at + n], network.width)
        for low in range(0, len(cells) if network.labels else 0, TOGETHER):
            some = slice(low, low + TOGETHER)
            np.add.at(sums, owner[some] + at, network.probabilities(cells[some], size[some]))
    total = sums.sum(axis=1)
    best = sums.argmax(axis=1)
    known = total > 0
    score = np.where(known, sums[np.arange(len(coded)), best] / np.where(known, total, 1.0), 0.0)
    return [network.labels[b] if k else UNKNOWN for b, k in zip(best, known)], np.clip(score, 0.0, 1.0)


def lettered(text: str) -> Column:
    """The text where it has a letter, else null."""
    return F.when(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)), F.col(text))


def predict(documents: DataFrame, network: Network, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, held_out, lang_pred, score (mean probability of that language).

    Null texts and texts without a letter are ``und`` with score 0. Null and repeated identities and
    repeated rows keep one row each; an empty table gives no rows; other columns are not read. Every byte
    of every text is labelled, in steps of bounded memory; nothing is shuffled.
    """
    rows = documents.select(F.col(identity).cast("long").alias("doc_id"), held_out(F.col(identity)).alias("held_out"), lettered(text).alias("text"))
    form = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            names, score = label_texts(network, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score)], schema=form)

    return rows.mapInArrow(lean(label), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(documents: DataFrame, network: Network, least_score: float = 0.3, text: str = "text") -> DataFrame:
    """The rows whose language is known with at least ``least_score``, with all columns of ``documents``."""
    place = documents.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, place):
            letters = [t if t and any(map(str.isalpha, t)) else None for t in batch.column(place).to_pylist()]
            names, score = label_texts(network, letters)
            yield batch.filter(pa.array([name != UNKNOWN and s >= least_score for name, s in zip(names, score)], pa.bool_()))

    return documents.mapInArrow(lean(keep), documents.schema)


def cuts(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Cut into (offset, texts) of at most ``most`` bytes beyond one text."""
    at = size = 0
    for i, text in enumerate(texts):
        if i > at and size + len(text) > most:
            yield at, i - at
            at, size = i, 0
        size += len(text)
    if len(texts) > at:
        yield at, len(texts) - at


def is_held_out(doc_id: int) -> bool:
    """The same split in plain Python, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 4 == 2
