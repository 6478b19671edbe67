"""Byte-level BPE encoding and decoding by a published rank table.

Within one piece the next merge is the leftmost adjacent pair of least rank. A segment tree over the
byte positions holds that minimum: a leaf is the rank of the pair that starts at its position, a merge
updates the two leaves of the live neighbours and clears the leaf that is gone, each in logarithmic time.
Short pieces run through the same tree side by side as numpy rows; a long piece has a tree of its own.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame

from pubtrack.llm.common import lean, texts_of

NONE = np.int32(2**31 - 1)
#: Longest piece that shares a tree with others, and most pieces in one such tree.
SHORT, TOGETHER = 32, 8192
#: Chunks of text whose ids are remembered; beyond that only those of the current step stay.
REMEMBERED = 150_000
#: Characters that are encoded in one step, to bound memory.
STEP_CHARS = 2_000_000


class Encoder:
    """Encoder and decoder for one rank table and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.bytes_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.pieces = regex.compile(pattern)
        # Spaces at which a text can be cut without changing its pieces: one side is not white space.
        self.cut = regex.compile(r"(?<=\S)\x20|\x20(?=\S)")
        self.doubtful = regex.compile(r"\s\x20(?:\s|\Z)")
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))[order]
        self.pairs = pairs
        # Ranks of pairs of single bytes, which all pieces start from.
        self.byte_pairs = self.pair_ranks(np.repeat(self.bytes_ids, 256), np.tile(self.bytes_ids, 256)).reshape(256, 256)
        self.names = [str(i) for i in range(max(self.tokens) + 1)]
        self.by_text = {str(rank).encode(): token for rank, token in self.tokens.items()}
        self.memory: dict[str, bytes] = {}

    @classmethod
    @lru_cache(maxsize=4)
    def load(cls, path: str, pattern: str) -> Encoder:
        """Encoder of a file with one base64 token and its rank per line."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, which is also the id of the merged token; NONE where there is none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def merge_short(self, pieces: list[bytes]) -> list[bytes]:
        """Ids, as decimal text, of pieces of at most SHORT bytes."""
        n, width = len(pieces), 1
        while width < max(map(len, pieces)):
            width *= 2
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
        place = np.arange(width)
        ids = np.where(place < lengths[:, None], self.bytes_ids[raw], -1)
        after = np.tile(np.minimum(place + 1, width - 1), (n, 1))
        ahead = np.tile(np.maximum(place - 1, 0), (n, 1))
        tree = np.full((n, 2 * width), NONE, dtype=np.int32)
        if width > 1:
            tree[:, width:2 * width - 1] = np.where(ids[:, 1:] >= 0, self.byte_pairs[raw[:, :-1], raw[:, 1:]], NONE)
            for node in range(width - 1, 0, -1):
                tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

        def update(rows, positions, values):
            nodes = positions + width
            tree[rows, nodes] = values
            while nodes[0] > 1:
                nodes = nodes >> 1
                tree[rows, nodes] = np.minimum(tree[rows, 2 * nodes], tree[rows, 2 * nodes + 1])

        live = np.flatnonzero(tree[:, 1] < NONE) if width > 1 else np.empty(0, dtype=np.int64)
        while len(live):
            node, least = np.ones(len(live), dtype=np.int64), tree[live, 1]
            while node[0] < width:
                node = 2 * node
                node += tree[live, node] != least  # the left child wins ties
            left = node - width
            right = after[live, left]
            ids[live, left], ids[live, right] = least, -1
            end = right == width - 1
            follower = np.where(end, width - 1, after[live, right])
            # The pair that started at the right half is gone, unless nothing follows it.
            after[live, left] = follower
            ahead[live, follower] = np.where(end, ahead[live, follower], left)
            update(live, right, NONE)
            next_id = np.where(end, -1, ids[live, follower])
            update(live, left, self.pair_ranks(ids[live, left], next_id))
            before = ahead[live, left]
            has = left > 0
            if has.any():
                rows, b, at = live[has], before[has], left[has]
                update(rows, b, self.pair_ranks(ids[rows, b], ids[rows, at]))
            live = live[tree[live, 1] < NONE]
        names = self.names
        flat = [names[i] for i in ids[ids >= 0].tolist()]
        counts, out, at = (ids >= 0).sum(axis=1).tolist(), [], 0
        for count in counts:
            out.append(",".join(flat[at:at + count]).encode())
            at += count
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """Ids, as decimal text, of one long piece."""
        n, width, none = len(piece), 1, int(NONE)
        while width < n:
            width *= 2
        ids = self.bytes_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        pair = self.pairs.get
        for i in range(n - 1):
            tree[width + i] = pair(ids[i] << 32 | ids[i + 1], none)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def update(at, value):
            node = at + width
            tree[node] = value
            while node > 1:
                node >>= 1
                left, right = tree[2 * node], tree[2 * node + 1]
                tree[node] = left if left <= right else right

        while tree[1] < none:
            least, node = tree[1], 1
            while node < width:
                node *= 2
                if tree[node] != least:
                    node += 1
            left = node - width
            right = after[left]
            follower = after[right]
            ids[left], ids[right], after[left] = least, -1, follower
            update(right, none)
            if follower < n:
                ahead[follower] = left
                update(left, pair(least << 32 | ids[follower], none))
            else:
                update(left, none)
            if ahead[left] >= 0:
                update(ahead[left], pair(ids[ahead[left]] << 32 | least, none))
        return ",".join([str(i) for i in ids if i >= 0]).encode()

    def chunks(self, text: str) -> list[str]:
        """Cut ``text`` at spaces that no piece crosses; a space stays in front of its chunk."""
        if self.doubtful.search(text):
            parts = self.cut.split(text)
        else:
            parts = text.split(" ")
        return [parts[0], *[" " + part for part in parts[1:]]]

    def learn(self, chunks: set[str]) -> None:
        """Put the ids of new chunks into the memory, short pieces of equal tree size side by side."""
        split = {chunk: [piece.encode() for piece in self.pieces.findall(chunk)] for chunk in chunks}
        ids: dict[bytes, bytes] = {}
        by_width: dict[int, list[bytes]] = {}
        for piece in {piece for pieces in split.values() for piece in pieces}:
            if len(piece) > SHORT:
                ids[piece] = self.merge_long(piece)
            else:
                by_width.setdefault((len(piece) - 1).bit_length(), []).append(piece)
        for pieces in by_width.values():
            for at in range(0, len(pieces), TOGETHER):
                some = pieces[at:at + TOGETHER]
                ids.update(zip(some, self.merge_short(some)))
        for chunk, pieces in split.items():
            self.memory[chunk] = b",".join([ids[piece] for piece in pieces])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as decimal text joined by commas; what is new in any of them is learned at once."""
        parts = [self.chunks(text) for text in texts]
        wanted = set().union(*parts)
        new = wanted.difference(self.memory)
        if len(self.memory) + len(new) > REMEMBERED:
            # What this step needs again is kept: frequent chunks are in every step.
            self.memory = {chunk: self.memory[chunk] for chunk in wanted.intersection(self.memory)}
        self.learn(new)
        memory = self.memory
        return [b",".join([ids for chunk in chunks if (ids := memory[chunk])]) for chunks in parts]

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the tokens of comma-joined decimal ids."""
        return b"".join([self.by_text[i] for i in ids.split(b",")]) if ids else b""


def steps(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Cut a batch into (offset, rows) of at most 1,000 rows and, beyond one row, STEP_CHARS characters."""
    at = n = size = 0
    for i, length in enumerate(pa.compute.utf8_length(texts).to_pylist()):
        if n and (n == 1000 or size + length > STEP_CHARS):
            yield at, n
            at, n, size = i, 0, 0
        n, size = n + 1, size + length
    if n:
        yield at, n


def encode_documents(documents: DataFrame, path: str, pattern: str, identity: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per document row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``,
    ``ids`` (array<int>). ``decoded_sha256`` is the digest of the bytes that the ids decode to.

    ``path`` names the rank file, which every executor has, and ``pattern`` the split into pieces.
    Null and empty texts have no ids. Null and repeated identities and repeated rows keep one row each;
    an empty table gives no rows; other columns are not read. Rows never meet, so nothing is shuffled.
    """
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        fields.append(pa.field("ids", pa.list_(pa.int32())))
        schema += ", ids array<int>"
    form = pa.schema(fields)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(path, pattern)
        try:
            for batch in batches:
                for at, n in steps(batch.column("text")):
                    part = batch.slice(at, n)
                    counts, digests, decoded, ids = [], [], [], []
                    for coded in encoder.encode_batch(part.column("text").to_pylist()):
                        counts.append(coded.count(b",") + 1 if coded else 0)
                        digests.append(hashlib.sha256(coded).hexdigest())
                        decoded.append(hashlib.sha256(encoder.decode(coded)).hexdigest())
                        if keep_ids:
                            ids.append(np.array(coded.split(b","), dtype=np.int32) if coded else [])
                    columns = [part.column("doc_id"), counts, digests, decoded, *([ids] if keep_ids else [])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if isinstance(c, list) else c for c, f in zip(columns, form)], schema=form)
        finally:
            encoder.memory = {}  # the encoder stays for the next task of this process, what it learned goes

    return texts_of(documents, identity, text).mapInArrow(lean(encode), schema)
