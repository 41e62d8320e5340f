"""Operator 7, byte-level BPE: each pattern match is merged through a segment tree over its byte positions.

Leaf *i* of the tree holds ``rank * width + i`` for the pair that starts at live position *i* (or nothing), so the root
is the leftmost pair of least rank. A merge is three point updates: the absorbed position goes, and the pairs that
start at the merged position and at its left neighbour are ranked anew. Short pieces of a batch share vectorised
trees, one row each; long pieces use one tree each.

Defined results: a null text is the empty text with no tokens; repeated rows give repeated equal rows; a piece of any
length costs O(n log n); an empty table gives no rows; other columns, of whatever name, are left aside.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import STEP_BYTES, give_back, in_batches, slices

#: Longest piece, in bytes, that goes to the shared trees.
SHORT = 32
#: Pieces remembered in a worker at most; the memory is emptied when it is full.
REMEMBERED = 200_000
NONE = np.int64(1) << np.int64(62)


class Vocabulary:
    """Ranks of a tokenizer file (base64 bytes and rank a line) and the rank of every mergeable pair of ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        self.bytes = dict(zip(ranks.values(), ranks.keys()))
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where it doesn't merge (or an id is -1)."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], NONE)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_many(pieces: list[bytes], vocab: Vocabulary, width: int) -> list[bytes]:
    """Ids (little-endian 32-bit) of pieces of 1 to ``width`` bytes; ``width`` is a power of two."""
    n = len(pieces)
    sizes = np.fromiter(map(len, pieces), np.int64, n)
    live = np.arange(width) < sizes[:, None]
    token = np.full((n, width + 1), -1, np.int64)
    token[:, :width][live] = vocab.single[np.frombuffer(b"".join(pieces), np.uint8)]
    at = np.arange(width)
    following = np.broadcast_to(np.minimum(at + 1, width), (n, width)).copy()
    before = np.broadcast_to(at - 1, (n, width)).copy()
    tree = np.full((n, 2 * width), NONE, np.int64)
    rank = vocab.rank(token[:, :-1], token[:, 1:])
    tree[:, width:] = np.where(rank < NONE, rank * width + at, NONE)
    for node in range(width - 1, 0, -1):
        np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])

    def put(rows: np.ndarray, position: np.ndarray, value: np.ndarray) -> None:
        node = position + width
        tree[rows, node] = value
        while node[0] > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def ranked(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        r = vocab.rank(token[rows, left], token[rows, right])
        return np.where(r < NONE, r * width + left, NONE)

    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        best = tree[rows, 1]
        here = best & (width - 1)
        gone = following[rows, here]
        token[rows, here] = best // width
        token[rows, gone] = -1
        then = following[rows, gone]
        following[rows, here] = then
        linked = then < width
        before[rows[linked], then[linked]] = here[linked]
        put(rows, gone, np.full(len(rows), NONE))
        put(rows, here, ranked(rows, here, then))
        left = before[rows, here]
        some = left >= 0
        if some.any():
            put(rows[some], left[some], ranked(rows[some], left[some], here[some]))
        rows = rows[tree[rows, 1] < NONE]
    kept = token[:, :width] >= 0
    ids = token[:, :width][kept].astype("<u4").tobytes()
    ends = 4 * np.cumsum(kept.sum(1))
    return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def merge_one(piece: bytes, vocab: Vocabulary) -> bytes:
    """Ids of one piece of any length, through a tree of its own."""
    n = len(piece)
    width = 1 << max(1, (n - 1).bit_length())
    token = vocab.single[np.frombuffer(piece, np.uint8)].tolist() + [-1]
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    none, pairs = int(NONE), vocab.pairs
    tree = [none] * (2 * width)

    def ranked(a: int, b: int) -> int:
        r = pairs.get(token[a] << 32 | token[b]) if b < n else None
        return none if r is None else r * width + a

    def put(position: int, value: int) -> None:
        node = position + width
        tree[node] = value
        while node > 1:
            node >>= 1
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b

    for i in range(n - 1):
        tree[width + i] = ranked(i, i + 1)
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    while (best := tree[1]) < none:
        rank, here = divmod(best, width)
        gone = following[here]
        then = following[gone]
        token[here], token[gone] = rank, -1
        following[here] = then
        if then < n:
            before[then] = here
        put(gone, none)
        put(here, ranked(here, then))
        if (left := before[here]) >= 0:
            put(left, ranked(left, here))
    return np.array([t for t in token[:n] if t >= 0], "<u4").tobytes()


def merge(pieces: list[bytes], vocab: Vocabulary) -> list[bytes]:
    """Ids of non-empty pieces, in their order."""
    out: list[bytes] = [b""] * len(pieces)
    by_width: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        if len(p) > SHORT:
            out[i] = merge_one(p, vocab)
        else:
            by_width.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(i)
    for width, where in by_width.items():
        for k in range(0, len(where), 8192):
            part = where[k : k + 8192]
            for i, ids in zip(part, merge_many([pieces[i] for i in part], vocab, width)):
                out[i] = ids
    return out


class Encoder:
    """Whole texts to ids; what a worker has merged once it looks up afterwards."""

    def __init__(self, path: str, pattern: str):
        self.vocab = vocabulary(path)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.find(t) for t in texts]
        new = list(set().union(*split).difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(set().union(*split))
        self.known.update(zip(new, merge([p.encode() for p in new], self.vocab)))
        out = [b"".join(map(self.known.__getitem__, pieces)) for pieces in split]
        for p in new:
            if len(p) > 4 * SHORT:
                del self.known[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _runs(texts: list[str | None]) -> Iterator[list[str]]:
    run, held = [], 0
    for t in texts:
        run.append(t or "")
        held += len(run[-1])
        if held > STEP_BYTES:
            yield run
            run, held = [], 0
    if run:
        yield run


def forget() -> None:
    """Give back what a task has loaded and merged: its worker lives on, and other operators need the memory."""
    encoder.cache_clear()
    vocabulary.cache_clear()
    give_back()


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the token ids of each whole text, as little-endian unsigned 32-bit integers (``ids`` binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in slices(batches):
            at = 0
            for texts in _runs(batch.column(1).to_pylist()):
                ids = e.encode(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
                at += len(ids)

    return in_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the bytes (``data``) that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path).bytes
        for batch in slices(batches):
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                data = [b"".join(map(known.__getitem__, np.frombuffer(i.as_buffer(), "<u4").tolist())) for i in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each whole text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in slices(batches):
            at = 0
            for texts in _runs(batch.column(1).to_pylist()):
                ids = e.encode(texts)
                sha = [hashlib.sha256(i).hexdigest() for i in ids]
                back = [hashlib.sha256(e.decode(i)).hexdigest() for i in ids]
                columns = [batch.column(0).slice(at, len(ids)), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(sha), pa.array(back)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at += len(ids)
        forget()

    return in_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
