"""Operator 2, toxicity over a noisy channel.

1. A character trigram model is counted over all texts.
2. Words written with digits or signs for letters, letter by letter, with separators or with stretched letters become lattices of what
   each sign may stand for; the Viterbi path under the character model and the channel's costs is the restored word. A
   word may end in each gap between spaced letters, and does in gaps wider than the run's narrowest.
3. Restored words stand behind the text that they were found in, so that a wrong restoration hides nothing. A classifier
   learned from labelled rows scores the restored text: each stem (word or word prefix) that is
   significantly more frequent in toxic rows carries the probability of a toxic row that holds it, and a logistic model
   of a text's worst stem, how many such words it has and how many words at all gives the score.

Defined results: a null or empty text scores as one without any stem; labels with a null id or label are left out, and
repeated labels of an id count once, as toxic if any is; with no labelled rows every score is 0; repeated rows give
repeated equal rows; a null id counts as the empty text for the fold; whole texts and spans of any length are decoded;
an empty table gives no rows; other columns, of whatever name, are left aside.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spans, held_out, in_batches, slices, steps, sum_vectors, words_of

#: Labelled rows that the classifier is fitted on, about (a bound on the sample).
TRAIN_ROWS = 12_000
STEM_BITS = 22
PREFIXES = range(4, 9)
#: Chance, over all stems together, of taking up a stem that has nothing to do with the label.
CHANCE = 0.05
#: Longest span, in bytes, whose restored form is remembered, and how many are.
LONGEST = 96
REMEMBERED = 50_000

# What a sign may stand for in place of a letter.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "*": "aeiou", "(": "c", "<": "c",
}
#: Channel costs (nats): a sign in place of a letter, a sign that is noise, a doubled letter kept from a longer run.
COST_SIGN, COST_NOISE, COST_DOUBLE = 0.5, 12.0, 1.5
#: Signs that may be punctuation, at the cost of a sign, where they end a word.
PUNCTUATION = "!|+*(<"

_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100)))
SYMBOLS = len(_LETTERS) + 2  # 0: between words; the last: any other letter
_SYMBOL = {" ": 0} | {c: i + 1 for i, c in enumerate(_LETTERS)}
_OF_CODE = np.zeros(1 << 16, np.int64)
_OF_CODE[0x100:] = SYMBOLS - 1
_OF_CODE[0x2000:0x2070] = 0
for _c, _i in _SYMBOL.items():
    _OF_CODE[ord(_c)] = _i
_OF_CODE[0xF7] = 0

_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[128:] = True
_IS_LETTER[ord("a") : ord("z") + 1] = True
_IS_SIGN = np.zeros(256, bool)
_IS_SIGN[[ord(c) for c in SIGNS]] = True
#: What may stand between the letters of a word besides blanks.
_IS_JOIN = np.zeros(256, bool)
_IS_JOIN[[ord(c) for c in ".-_"]] = True
_IS_LEAD = np.ones(256, bool)
_IS_LEAD[0x80:0xC0] = False


# ------------------------------------------------------------------------------------------------------ character model
def trigram_counts(texts: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over all rows of the one column, of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SYMBOLS**3)
        for batch in slices(batches):
            for _, part in steps([t.lower() if t else "" for t in batch.column(0).to_pylist()]):
                codes = np.frombuffer(b" ".join(part).decode().encode("utf-16-le", "surrogatepass"), np.uint16)
                s = np.concatenate(([0, 0], _OF_CODE[codes], [0, 0]))
                counts += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        table = counts.reshape(SYMBOLS, -1)
        yield pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(SYMBOLS)]), pa.array([r.tobytes() for r in table], pa.binary())], names=["key", "vec"])

    out = np.zeros((SYMBOLS, SYMBOLS**2))
    for r in sum_vectors(texts.mapInArrow(run, "key string, vec binary")).collect():
        out[int(r.key)] = np.frombuffer(r.vec)
    return out.reshape((SYMBOLS,) * 3)


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of a symbol after two others, backing off to one and none."""
    one = counts.sum((0, 1)) + 1
    two = counts.sum(0)
    p1 = one / one.sum()
    p2 = (two + 5 * p1) / (two.sum(-1, keepdims=True) + 5)
    p3 = (counts + 5 * p2) / (counts.sum(-1, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


def in_gap(c: str) -> bool:
    return c < "\x80" and c not in SIGNS and not c.isalpha()


def options(span: str) -> list[list[tuple[str, float]]]:
    """The lattice of a span: for each place, what it may stand for and the cost."""
    out: list[list[tuple[str, float]]] = []
    narrow = min((len(list(g)) for gap, g in itertools.groupby(span, in_gap) if gap), default=0)
    word = len(span.rstrip(PUNCTUATION))
    at = 0
    while at < len(span):
        c = span[at]
        n = 1
        while at + n < len(span) and (in_gap(span[at + n]) if in_gap(c) else span[at + n] == c):
            n += 1
        if in_gap(c):
            out.append([("", 0.0), (" ", 0.0)] if n == narrow else [(" ", 0.0)])
        elif c in SIGNS:
            for i in range(at, at + n):
                out.append([*((x, COST_SIGN) for x in SIGNS[c]), ("", COST_NOISE if i < word else COST_SIGN)])
        elif c.isalpha():
            out.append([(c, 0.0)] if n == 1 else [(c, 0.0 if n > 2 else COST_DOUBLE), (c + c, COST_DOUBLE if n > 2 else 0.0)])
        at += n
    return out


def spelt(path: tuple | None) -> str:
    out = []
    while path:
        path, letters = path
        out.append(letters)
    return "".join(reversed(out))


def viterbi(span: str, model: np.ndarray) -> str:
    """The most likely words behind a disguised span. A path is the pair of the path before it and its last letters."""
    paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for place in options(span):
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in paths.items():
            for letters, cost in place:
                x, y, s = a, b, score - cost
                for c in letters:
                    z = _SYMBOL.get(c, SYMBOLS - 1)
                    s += float(model[x, y, z])
                    x, y = y, z
                if (x, y) not in new or s > new[x, y][0]:
                    new[x, y] = (s, (path, letters) if letters else path)
        paths = new
    ends = [(s + float(model[a, b, 0]), path) for (a, b), (s, path) in paths.items()]
    top = max(s for s, _ in ends)
    return max(spelt(path) for s, path in ends if s == top)


def disguised(data: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of lower-case text that may be disguised words: signs beside letters, stretched letters, words cut by a
    stop, hyphen or underscore, or single letters in a row."""
    letter, sign = _IS_LETTER[data], _IS_SIGN[data]
    start, end = words_of(data, _IS_LETTER | _IS_SIGN)
    if not len(start):
        return []
    mark = np.zeros(len(data) + 1, np.int64)
    odd = np.zeros(len(data), bool)
    odd[:-1] = sign[:-1] & letter[1:]
    odd[1:] |= sign[1:] & letter[:-1]
    odd[:-2] |= letter[:-2] & (data[:-2] == data[1:-1]) & (data[1:-1] == data[2:])
    np.cumsum(odd, out=mark[1:])
    found = mark[end] > mark[start]
    spans = list(zip(start[found].tolist(), end[found].tolist()))
    lead = np.concatenate(([0], np.cumsum(_IS_LEAD[data])))
    single = (lead[end] - lead[start] == 1) & (letter[start] | sign[start])
    near = np.zeros(len(start), bool)
    near[:-1] = single[:-1] & single[1:] & (start[1:] - end[:-1] <= 3)
    near[:-1] &= data[end[:-1]] != 10
    cut = np.zeros(len(start), bool)
    cut[:-1] = (start[1:] - end[:-1] == 1) & _IS_JOIN[data[end[:-1]]] & letter[end[:-1] - 1] & letter[start[1:]]
    for joined, least in ((near, 2), (cut, 1)):
        edge = np.diff(np.concatenate(([0], joined.astype(np.int8), [0])))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if b - a >= least:
                spans.append((int(start[a]), int(end[b])))
    # A span inside a longer one is restored with that.
    out, done = [], -1
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if b > done:
            out.append((a, b))
            done = b
    return out


class Restorer:
    """Restores the disguised words of texts; remembers what it has decoded."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.known: dict[bytes, bytes] = {}

    def word(self, span: bytes) -> bytes:
        word = self.known.get(span)
        if word is None:
            word = viterbi(span.decode("utf-8", "ignore"), self.model).encode()
            if len(span) <= LONGEST:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[span] = word
        return word

    def restored(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(the bytes of all texts, each with the restored forms of its disguised words behind it; where each ends)."""
        raw = b"\n\n\n".join(texts)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 3)
        extra: dict[int, list[bytes]] = {}
        for a, b in disguised(np.frombuffer(raw, np.uint8)):
            word = self.word(raw[a:b])
            if word != raw[a:b].rstrip(PUNCTUATION.encode()):
                extra.setdefault(int(np.searchsorted(ends, a, "right")), []).append(word)
        if extra:
            texts = [b"\n".join([t, *extra[i]]) if i in extra else t for i, t in enumerate(texts)]
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 3)
            raw = b"\n\n\n".join(texts)
        return np.frombuffer(raw, np.uint8), ends


def stems(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(row of each word; for whole words and then prefixes of each length: which words have one, and its bin)."""
    start, end = words_of(data, _IS_LETTER)
    spans = Spans(data)
    shift = np.uint64(64 - STEM_BITS)
    word = np.arange(len(start))
    out = [(word, (spans.hash(start, end) >> shift).astype(np.int64))]
    for n in PREFIXES:
        word = word[end[word] - start[word] > n]
        out.append((word, (spans.hash(start[word], start[word] + n) >> shift).astype(np.int64)))
    return np.searchsorted(ends, start, "right"), out


def evidence(data: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Of each row: logit of its worst word's chance, logs of how many words have a chance and how many words it has."""
    row, found = stems(data, ends)
    chance = np.zeros(len(row), np.float32)
    for word, b in found:
        c = table[b]
        some = np.flatnonzero(c)
        np.maximum.at(chance, word[some], c[some])
    hit = np.flatnonzero(chance)
    worst = np.full(len(ends), 0.01)
    np.maximum.at(worst, row[hit], chance[hit])
    strong = hit[chance[hit] >= 0.7]
    counts = [np.bincount(r, minlength=len(ends)) for r in (row[hit], row[strong], row)]
    return np.column_stack([np.ones(len(ends)), np.log(worst / (1 - worst)), *(np.log1p(c) for c in counts)])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


# ------------------------------------------------------------------------------------------------------------ classifier
@dataclass
class Model:
    characters: np.ndarray
    bins: np.ndarray
    chances: np.ndarray
    weights: np.ndarray
    _table: np.ndarray | None = field(default=None, repr=False)

    def table(self) -> np.ndarray:
        if self._table is None:
            self._table = np.zeros(1 << STEM_BITS, np.float32)
            self._table[self.bins] = self.chances
        return self._table

    def __getstate__(self):
        return self.__dict__ | {"_table": None}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Count characters over all texts; fit stems on a bounded sample of the labelled rows that are not held out."""
    text = F.col(text_col).cast("string").alias("text")
    characters = log_model(trigram_counts(in_batches(docs).select(text)))
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    n = known.count()
    part = min(1.0, TRAIN_ROWS / max(1, n))
    sample = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < part * (1 << 20))
    rows = docs.select(F.col(id_col).alias("id"), text).join(F.broadcast(sample), "id").select("text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(characters)
        sums = np.zeros((2, 1 << STEM_BITS), np.int32)
        numbers = [0, 0]
        for batch in slices(batches):
            label = np.array([int(bool(x)) for x in batch.column(1).to_pylist()])
            for k in (0, 1):
                numbers[k] += int((label == k).sum())
            for at, part in steps([t.lower() if t else "" for t in batch.column(0).to_pylist()]):
                row, found = stems(*restorer.restored(part))
                seen = np.unique(np.concatenate([row[w] << STEM_BITS | b for w, b in found]))
                own = label[at + (seen >> STEM_BITS)]
                for k in (0, 1):
                    sums[k] += np.bincount(seen[own == k] & ((1 << STEM_BITS) - 1), minlength=1 << STEM_BITS).astype(np.int32)
        some = np.flatnonzero(sums.any(0))
        for i in range(0, len(some), 1 << 16):
            b = some[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(sums[1, b], pa.int32()), pa.array(sums[0, b], pa.int32())], names=["bin", "pos", "neg"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([numbers[1]], pa.int32()), pa.array([numbers[0]], pa.int32())], names=["bin", "pos", "neg"])

    counted = rows.mapInArrow(count, "bin int, pos int, neg int").groupBy("bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # Of the stems only those that could be significant at the usual share of toxic rows come to the driver: their
    # number is bounded by the sample.
    got = counted.filter((F.col("bin") < 0) | (F.col("pos") >= 4) & (F.col("pos") > F.col("neg"))).collect()
    total = next(((r.pos, r.neg) for r in got if r.bin < 0), (0, 0))
    if not sum(total):
        return Model(characters, np.zeros(0, np.int64), np.zeros(0, np.float32), np.array([-99.0, 0, 0, 0, 0]))
    base = min(max(total[0] / sum(total), 1e-3), 0.49)
    limit = math.log((sum(total) * 50) / CHANCE)
    bins, chances = [], []
    for r in got:
        if r.bin >= 0:
            share = (r.pos - 1e-9) / (r.pos + r.neg)
            if (r.pos + r.neg) * (share * math.log(share / base) + (1 - share) * math.log((1 - share) / (1 - base))) > limit:
                bins.append(r.bin)
                chances.append((r.pos + base) / (r.pos + r.neg + 1))
    model = Model(characters, np.array(bins, np.int64), np.array(chances, np.float32), np.zeros(5))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, table = Restorer(characters), model.table()
        for batch in slices(batches):
            label = batch.column(1).to_pylist()
            for at, part in steps([t.lower() if t else "" for t in batch.column(0).to_pylist()]):
                x = evidence(*restorer.restored(part), table)
                y = np.array([bool(k) for k in label[at : at + len(part)]], float)
                yield pa.RecordBatch.from_arrays([pa.array([np.column_stack([x, y]).tobytes()], pa.binary())], names=["rows"])

    # A few numbers for each row of the bounded sample.
    fit = np.concatenate([np.frombuffer(r.rows).reshape(-1, 6) for r in rows.mapInArrow(weigh, "rows binary").collect()])
    fit = fit[np.lexsort(fit.T)]
    model.weights = logistic(fit[:, :5], fit[:, 5])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    names = ["doc_id", "held_out", "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, table = Restorer(model.characters), model.table()
        for batch in slices(batches):
            out = np.zeros(batch.num_rows)
            for at, part in steps([t.lower() if t else "" for t in batch.column(2).to_pylist()]):
                x = evidence(*restorer.restored(part), table)
                out[at : at + len(part)] = 1 / (1 + np.exp(-(x @ model.weights).clip(-40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64()), pa.array((out >= 0.5).astype(np.int32))], names=names)

    return in_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
